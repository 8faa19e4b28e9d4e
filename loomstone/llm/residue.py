"""Template residue, filler, error pages and script notices standing in place of content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from unicodedata import combining, normalize

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomstone.operators.skew import lookup
from loomstone.runtime import Scratch

#: A message that its words alone do not settle counts once it stands in so many documents of so many sources.
WIDE_DOCUMENTS, WIDE_SOURCES = 5, 2
#: Dummy words that make a stretch of filler within a sentence.
LATIN_WORDS = 5
#: Share of a message's words that may be unknown to it if it speaks to the reader, if not, and if it tells of the past.
DIRECT, PLAIN, PAST = 0.34, 0.15, 0.1
#: The same where the message must also recur widely; no message has more.
WIDE_DIRECT, WIDE_PLAIN = 0.4, 0.2

# --- fixed values: words of placeholders and filler, in natural order -------------------------------------------------
#: Last words of the names of fields that templates leave open.
HEADS = (
    "address", "adresse", "amount", "author", "birthday", "body", "brand", "category", "city", "client", "code", "company", "contact", "content", "country", "customer", "data", "date", "datum", "day", "deadline", "department",
    "description", "details", "e-mail", "email", "event", "fee", "firma", "firmy", "goal", "headline", "id", "imię", "industry", "jméno", "keyword", "link", "list", "location", "message", "month", "name", "nazwa", "nazwisko", "nom", "nombre", "prénom", "vorname", "nachname", "příjmení", "apellido", "cognome", "apellidos",
    "number", "name einfügen", "název", "occupation", "order", "organisation", "organization", "owner", "percentage", "phone", "place", "position", "price", "product", "quantity", "reason", "recipient", "reference", "reviewer", "role", "salutation", "sender", "service",
    "signature", "site", "skill", "state", "street", "subject", "summary", "surname", "team", "telephone", "text", "time", "title", "topic", "total", "url", "username", "value", "venue", "version", "website", "year", "zip",
)
#: First words of what a template asks to be filled in.
ASKS = "insert|enter|your|my|add|type|fill in|choose|select|pick|write|describe|to be completed:?|to be confirmed|to be announced|tbd|tbc|tba|todo|placeholder|doplňte|vložte|einfügen|bitte|wpisz|uzupełnij|wstaw|insérer|insertar|inserire"
#: Tags of HTML, which are no placeholders.
TAGS = (
    "a", "abbr", "article", "b", "body", "br", "button", "code", "dd", "div", "dl", "dt", "em", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "i", "img", "input", "kbd", "label", "li", "link", "main", "mark", "meta", "nav", "noscript", "ol", "option", "p",
    "pre", "q", "s", "script", "section", "select", "small", "span", "strong", "style", "sub", "sup", "svg", "table", "tbody", "td", "th", "thead",
    "tr", "u", "ul", "var",
)
#: Words of the usual dummy Latin.
LATIN = (
    "ac ad adipiscing aliqua aliquam amet ante arcu augue bibendum commodo consectetur cras cursus dapibus diam dolor dolore donec dui duis eget eiusmod "
    "elementum elit enim erat eros est et etiam eu euismod ex facilisis fames faucibus felis fermentum feugiat fringilla fusce gravida hendrerit iaculis id "
    "imperdiet in incididunt integer ipsum justo labore lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa "
    "mattis mauris maximus metus mi minim mollis morbi nam nec neque nibh nisi nisl non nostrud nulla nullam nunc odio orci ornare pellentesque pharetra "
    "phasellus placerat porta porttitor posuere praesent pretium proin pulvinar purus quam quis quisque rhoncus risus rutrum sagittis sapien scelerisque sed "
    "sem semper sit sodales sollicitudin suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamcorper ultrices urna ut varius "
    "aenean blandit condimentum convallis curabitur dictum dignissim egestas eleifend finibus habitant hac interdum netus platea senectus "
    "aute cillum culpa cupidatat deserunt ea esse excepteur exercitation fugiat irure laboris laborum occaecat officia pariatur proident reprehenderit sint sunt ullamco voluptate aliquip anim consequat "
    "vehicula vel velit veniam vestibulum vitae vivamus viverra volutpat vulputate"
).split()
# --- fixed values: words of messages, by what they say, in natural order ----------------------------------------------
#: What pages run on.
TECH = "javascripts javascript js script scripts scripting cookie cookies activecontent scriptsupport webgl flash skript skripte skripts skripty skriptů skrypty skryptów skryptu javascriptu javascripte plugin plugins noscript"
#: Asking to let it run, and that it is let run.
ENABLE = (
    "enable enabling enabled activate activated activating allow allowed allowing activation aktivierung aktivace unblock accept accepting reenable akzeptieren schalten zulässt spusťte aktiviere aktivieren aktiviert einschalten erlauben erlaube zulassen zapněte zapnout povolte povolit aktivujte "
    "włącz włączyć włączona włączonej włączone zezwól zezwolić aktywuj activez activer autorisez active activar active habilite habilitar habilita activa abilita abilitare attiva attivare ative ativar inschakelen schakel"
)
NEED = (
    "need needs needed require requires required requiring must necessary mandatory has have having benötigt benötigen erforderlich notwendig braucht vyžaduje vyžadován potřebuje nutný nutné wymaga wymagany wymagana potrzebujesz requiere "
    "requerido necesita necesario nécessite nécessaire requis richiede richiesto necessario requer necessário vereist nodig"
)
OFF = (
    "disabled nepodporuje podporován obsługuje supporté soportado suportado deactivated off blocked blocking unsupported outdated old inactive missing turnedoff notenabled unterstützt deaktiviert ausgeschaltet blockiert veraltet vypnutý vypnuté vypnutá vypnut zakázán zakázán blokován blokuje wyłączona wyłączony wyłączone "
    "zablokowane désactivé désactivés bloqué desactivado deshabilitado bloqueado disabilitato disattivato desativado uitgeschakeld"
)
WITHOUT = "without ohne bez sans sin senza sem zonder"
NOT = (
    "not no cannot never unable failed fails fail failing failure nolonger nothing none neither nicht kein keine keinen konnte konnten kann ne pas non nemá není nejsou nelze nemůže nepodařilo nebyl nebyla nebylo nebyly nemáte neexistuje nenalezena nenalezen nenalezeno nedostupná nedostupný nie brak "
    "można udało istnieje znaleziono no encontrada encontrado encontró existe impossible introuvable trouvée trouvé existe inexistante trovata trovato impossibile encontrada indisponível niet"
)
#: Things that a page tells of.
THING = (
    "requests urls errors aplicación navigateur webseiten website's page pages site website webpage web app application file document record resource content view viewer link url address server host gateway service request connection session video image preview attachment account "
    "database item article post folder workspace board dashboard login user users experience feature features functionality map player form search result results query operation network proxy domain certificate system store board portal shop cart checkout game editor "
    "seite seiten webseite datei dokument inhalt anwendung adresse dienst verbindung sitzung zugriff anfrage server stránka stránku stránky stránce strana dokument dokumentu soubor souboru aplikace aplikaci obsah server služba spojení relace odkaz přístup strona strony stronę pliku plik dokumentu aplikacja aplikacji usługa serwer połączenie sesja dostęp "
    "página paginas sitio archivo servicio servidor acceso sesión enlace contenido fichier site serveur accès lien contenu pagina sito servizio accesso risorsa ficheiro arquivo site serviço servidor acesso conteúdo"
)
#: What was to be done with it.
DONE = (
    "found find load loaded loading open opened display displayed show shown reach reached reachable connect connected connecting establish established establishing process processed complete completed retrieve retrieved access accessed accessing render rendered rendering "
    "exist exists respond responded respondig locate located fetch fetched read view viewed viewing available resolve resolved handle handled fulfilled fulfill work works working function run running start started get got answer response looking see use using play played verify verified "
    "nefunguje odpovídá odpowiada reagiert funktioniert funktionieren responde répond risponde funciona fonctionne funziona działa deliver delivered finish finished serve served parse parsed save saved send sent submit submitted upload uploaded download downloaded nenalezena nenalezen satisfied private secure trusted dostępu zugriff přístup existieren utworzono neexistuje istnieje existe existiert introuvable trouvée trouvé encontrada encontrado encontró trovata trovato znaleziono nenalezeno gefunden geladen angezeigt anzeigen geöffnet aufgebaut erreichbar verfügbar laden zobrazit zobrazení zobrazena načíst načten najít nalezena nalezen otevřít dostupná dostupný znaleziono wyświetlić wyświetlenia załadować otworzyć dostępna dostępny zobaczyć cargar mostrar abrir disponible charger afficher ouvrir disponible caricare "
    "visualizzare aprire disponibile carregar exibir disponível"
)
#: States that say by themselves that there is no content.
STATE = (
    "nedostupný nedostupná nedostupné niedostępny niedostępna niedostępne unreachable inaccessible downtime unavailable expired maintenance timeout offline overloaded forbidden unauthorized unauthorised denied signout abgelaufen wartung wartungsarbeiten verweigert verboten vypršela vypršel údržba údržbu odepřen zakázán wygasła odmowa zabroniony przerwa "
    "caducado mantenimiento denegado prohibido expiré refusé interdit scaduta manutenzione negato vietato expirou manutenção negado"
)
#: States that do so when something is said to be in them.
BEEN = (
    "broken down moved removed deleted suspended restricted refused rejected banned limited exceeded interrupted reset aborted terminated gone busy crashed blocked closed cancelled disabled entfernt gelöscht verschoben gesperrt přesunut přesunuta odstraněn smazán usunięta usunięty przeniesiona "
    "eliminado movido supprimé supprimée déplacée rimossa spostata removida"
)
IS = "is are was were been be being got wurde wurden ist byl byla bylo je został została jest été ha sido stato stata foi has"
FAULT = "difficulties issue issues mistake glitch bug warning uncaught error errors exception fault problem trouble wrong internal fatal unexpected unknown invalid empty bad fehler fehlermeldung fehlercode chyba chybě kód błąd błędu erreur erreurs errore erro problema problème code status http err"
#: Speaking to the reader.
READER = (
    "please you your you're yours sorry apologies apologize oops whoops uh oh ooops hmm hm unfortunately bitte sie ihr ihre ihrem ihren ihres leider prosím vy váš vaše vašem svém omlouváme bohužel proszę twoja twojej twój przepraszamy niestety por favor su tu lo sentimos veuillez votre vous désolé désolés merci per favore tuo suo "
    "spiacenti seu sua desculpe alstublieft uw"
)
#: What the reader should do about it.
ADVICE = (
    "try retry again later reload refresh refreshing update upgrade contact support administrator admin webmaster back home homepage start startpage check checking verify continue continuing proceed signin login logout return settings setting preferences options few shortly soon moment minutes minute seconds second hours once then first before after otherwise owner operator help helpdesk team mistake believe think persists persist "
    "versuchen erneut später laden prüfen aktualisieren zurück startseite zkuste zkontrolujte později znovu obnovte zpět spróbuj ponownie później odśwież wróć inténtelo nuevo tarde réessayez plus tard riprova più tardi tente novamente mais tarde contenter tell goes spam wait anmelden einzuloggen přihlásit zalogować upgrading disable"
)
#: Other words of such messages.
AROUND = (
    "technical difficulties capacity undergoing undergo upstream peer internet further directory end exceeding overload derzeit aktuell zurzeit momentan dočasně momentálně právě obecnie chwilowo tymczasowo actualmente actuellement momentanément temporaneamente dispositivo hledáte suchen angeforderte angeforderten żądana demandée solicitada richiesta recurso ressource properly improve verification security ray performance reason reasons owner side takes long seems unless gone reach visit visiting visited join experience store stores " 
    "browser browsers browserem prohlížeč prohlížeči prohlížeče przeglądarka przeglądarce przeglądarki navigateur navegador client device version modern newer latest chrome firefox safari permission permissions authorized authorised allowed authentication credentials login private filter policy region country ip security firewall captcha robot human bot "
    "requested asked desired following original shared current properly correctly fully currently temporarily momentarily presently down still longer either possibly perhaps maybe seems seem appears appear looks look like detected noticed apparently something went happened occurred occurs encountered caused returned sent gave received existiert existieren obsługę obsługi korzystać nutzung nutzen používání fungování usar utiliser utilizar usare funcionar fonctionner funzionare html consider considering supports ad ads adblock blocker adblocker scheduled planned inactivity location via instead safe safely occurred while trying attempting doing performing being "
    "administrator message reference id number many too much high traffic rate quota limit method supported support supporting full best order viewing reading content here there everything anything some most parts part nothing certain shortly soon right now time moment inconvenience"
)
#: Function words.
SMALL = (
    "ca wo between among about into over under muss müssen sich um para pour deze diese an a the this that these those it its is are was were be been being am do does did will would can could may might should shall of to in on at by for from with and or but so as if until unless because due than then there here we our us i me my they them their what which who when where while also just only "
    "der die das den dem des ein eine einen einer ist sind wurde wurden werden wird zu zum zur im in auf von für mit und oder um es diese dieser dieses dass nicht diesem "
    "je jsou byl byla bylo byly se si v ve na do z ze s a nebo i pro k ke o tato tento toto této tuto by požadovaný požadovaná požadovanou to tę ta ten w z i lub aby dla nie został została jest są żądana "
    "la le les un une de du des et ou est sont à en el los las una y o es son del al il lo gli e è di da per o os as um uma não foi pour para que se ce cette esta este está questa questo"
)
#: Words of people who tell of a page, against it being one.
TELLING = (
    "he she him his her said says say told asked reported wrote explained noted fixed redesigned withdrew added decided discussed introduced yesterday monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december which whose why how whether although since sagte schrieb erklärte řekl uvedl opravil powiedział "
    "example tutorial chapter article users developers visitors customers people several should usually often typically sometimes default"
)
#: What filler stands for, and how it says so.
STUFF = (
    "text texts copy content contents title titles headline heading subheading subtitle caption paragraph paragraphs description summary body image photo picture logo bio quote message name something anything yourself yourselves tagline slogan lines line sentence sentences words word bullet bullets points point section article abstract details info information lead intro introduction "
    "inhalt überschrift beschreibung titel bild nadpis popis obsah treść tytuł opis tekst nagłówek texto título contenido texte titre contenu testo titolo tekst"
)
DUMMY = "beispieltext beispielinhalt ukázkový ejemplo exemple esempio exemplo przykładowa placeholder placeholders dummy sample filler lorem boilerplate tbd tba todo xxx platzhalter platzhaltertext blindtext mustertext fülltext zástupný výplňový vzorový zastępczy zastępcza przykładowy marcador relleno remplissage segnaposto"
PUT = "bude doplněn doplněna uzupełniony vyplnit goes go comes belongs put place insert enter type write add replace replaced edit change fill describe delete remove provide paste einfügen eingeben ersetzen steht kommt folgt doplňte doplnit vložte napište vyplňte nahraďte bude wpisz wstaw uzupełnij zastąp będzie insertar insertez inserire inserisci escriba écrivez saisissez reemplazar"
HERE = "here hier zde tady sem tu tutaj aquí ici qui"
PUBLISH = "publish publishing published publication release going launch final freigabe veröffentlichung zveřejněním zveřejnění publikacją"
AROUND_FILLER = (
    "your own real actual final new some more few two three one about before after publishing publish publication release released going live launch later then this hint instructions max maximum short brief simple default used fill space only shown where until ready project site outcome website template theme layout design "
    "finish finished written soon coming bitte vor der freigabe später před zveřejněním zveřejnění przed publikacją"
)
#: Messages of languages written without blanks.
UNSPACED = (
    ("script notice", r"(?:javascript|スクリプト|クッキー|cookie|脚本).*(?:有効|オンに|許可|必要|启用|啟用|开启|打开)|(?:有効|启用|啟用|请开启|打开).*(?:javascript|スクリプト|cookie|脚本)"),
    ("error page", r"(?:ページ|ファイル|サイト|文書|画面|サーバー|データ).*(?:見つかりません|表示できません|存在しません|開けません|接続できません|読み込めません)|エラーが発生|アクセスが(?:拒否|禁止)|メンテナンス中|(?:页面|頁面|网页|文件|资源).*(?:不存在|未找到|找不到|无法|無法)|服务器(?:错误|内部错误)|(?:拒绝|禁止)访问|系统维护"),
    ("filler", r"(?:ダミー|サンプル|仮の?)(?:テキスト|文章|文字)|ここに.*(?:入力|入ります|記入)|此处(?:填写|输入|插入)|(?:占位|示例)(?:文本|文字)"),
)
#: Two words that say one thing.
JOINED = (
    (r"\b(?:turn|switch|turning|switching) (?:it |them )?on\b", "enable"), (r"\b(?:turned|switched) on\b", "enabled"), (r"\b(?:turned|switched) off\b", "disabled"), (r"\b(?:sign(?:ed)?|log(?:ged)?) (?:back )?in\b", "signin"),
    (r"\btim(?:ed|e)[ -]out\b", "timeout"), (r"\b(?:signed|logged) out\b", "signout"), (r"\bno longer\b", "nolonger"), (r"\bjava script\b", "javascript"), (r"\bactive content\b", "activecontent"), (r"\bscript support\b", "scriptsupport"),
    (r"\bn[’']t\b|(?<=\w)n[’']t\b", " not"), (r"\bcan not\b", "cannot"), (r"[’'](?:re|ve|ll|s|m|d)\b", ""), (r"\bback up\b", "back"), (r"\bset up\b", "setup"),
)

_WORDS = r"(?:[^\W_][\w'’.&/,-]*[ _]+)*"
_HEAD = "(?:" + "|".join(h.replace(" ", "[ _]?").replace("-", "[-_]?") for h in HEADS) + ")"
_FIELD = rf"{_WORDS}(?:[^\W_]*[._])*{_HEAD}s?(?:[ _]?here)?"
_NAME = r"[^\W\d][\w .\-]*"
_ONE = r"[^\W\d][\w.\-]*"
_FILL = rf"(?:{ASKS})\b[\w .:'’/\-]*"
PLACEHOLDER = re.compile(
    "|".join([
        rf"\$?\{{\{{ ?{_NAME} ?\}}\}}",  # {{ name }}
        rf"\$\{{ ?{_NAME} ?\}}",  # ${name}
        rf"\{{% ?{_NAME} ?%\}}",  # {% name %}
        rf"\{{(?:{_NAME}|\d)\}}",  # {name}, {0}
        rf"\${_ONE}\$", rf"#{_ONE}#", rf"@@{_NAME}@@", rf"%{_NAME}%", rf"%\({_NAME}\)s", r"(?<![\w%])%[sd](?!\w)",
        rf"\[\[(?:{_FIELD}|{_FILL}|[^\W\d]\w*[._][\w.]+)\]\]", rf"\[(?:{_FIELD}|{_FILL})\](?![(\[]|:\s*\S+[./])", r"\[object object\]", r"\[x{1,2}\]-\[x{1,2}\]-\[x{1,4}\]",
        rf"<<{_NAME}>>", rf"<(?:{_FIELD}|{_FILL})>", rf"<(?!(?:{'|'.join(TAGS)})>)[^\W\d][\w.\-]{{2,}}>", r"<!-- ?fill in ?-->", rf"<(?:\?=?|%=?) ?{_NAME} ?[?%]>", rf"&lt;{_NAME}&gt;",
        rf"«(?:{_FIELD}|{_FILL})»", rf"\((?:insert|enter) {_NAME}\)",
        rf"(?<!\w)__{_FIELD}__(?!\w)", r"(?<!\w)__(?-i:[A-ZÀ-ÖØ-ÞĀ-Ž][A-ZÀ-ÖØ-ÞĀ-Ž_\- .]+?)__(?!\w)",  # __bold__ words are none
        r"(?<![\w_])_{6,}(?![\w_])", r"\.{12,}",
        r"(?<![\w/])(?:dd/mm/yyyy|mm/dd/yyyy|tt\.mm\.jjjj|dd\.mm\.(?:rrrr|yyyy|0|))(?![\w/])", r"(?<!\w)x{2}\.x{2}\.(?:0|20)?x{2,4}(?!\w)",
        r"(?<![\w`])(?:(?-i:undefined)|null_value)(?![\w`])", r"\*\|\w+\|\*",
        r"\bmax muster(?:-?name|mann)\b", r"\bfirst ?name last ?name\b", r"\bimię nazwisko\b", r"\bjméno příjmení\b",
    ]),
    re.IGNORECASE,
)
#: The field rule of square brackets and guillemets in capitals, whatever the field is called.
CAPITALS = re.compile(r"[\[«<](?=[^\W\d_]{2})[A-ZÀ-ÖØ-ÞĀ-Ž][A-ZÀ-ÖØ-ÞĀ-Ž_\- ]{2,}[\]»>](?![(\[:])")
#: One of these stands in every placeholder.
_OPEN = re.compile(r"[{$@%\[<«]|\*\||#[^\W\d]|&lt;|__|\.{12}|\((?:insert|enter) |undefined|null_value|m/yyyy|d/yyyy|tt\.mm|dd\.mm|xx\.|max muster|first ?name|imię nazwisko|jméno příj", re.IGNORECASE)

_LATIN, _KEYS = frozenset(LATIN), frozenset("asdfghjklqwe")
#: Dummy words that are words of living languages too.
_ENGLISH = frozenset("a ad ante est et in me nec non sed sit sem urna ut vitae massa magna integer tempus libero dolor eros varius semper ex id orci cursus".split())
_ROWS = frozenset(("asd", "asdf", "hjkl", "jkl", "jklö", "qwer", "qwerty", "uiop", "wer", "yxcv", "zxcv"))
_FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~).*?(?:\n[ \t]*\1[^\n]*|\Z)", re.DOTALL)
_TICKS = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]")
_PREFIX = re.compile(r"^[\s﻿]*(?:(?:[#>*+\-•]+|\d+[.)])\s+)*")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n")
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = frozenset(".!?:;。…")
_DENSE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
# --- masks of numbers, dates and addresses --------------------------------------------------------------------------
_ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.\w+\b|\b(?:\d{1,3}\.){3}\d{1,3}\b")
_IDENT = re.compile(r"\b(?=[a-z\-]*\d)(?=[\d\-]*[a-z])[0-9a-f]{4,}(?:-[0-9a-f]{2,})*\b")
_NUMBER = re.compile(r"\d+(?:[.,:/\-]\d+)*")

# what a word can say, as bits
_SAYS = ("tech", "enable", "need", "off", "without", "not_", "thing", "done", "state", "been", "is_", "fault", "reader", "advice", "around", "small", "stuff", "dummy", "put", "here", "publish", "filling")
TECH_, ENABLE_, NEED_, OFF_, WITHOUT_, NOT_, THING_, DONE_, STATE_, BEEN_, IS_, FAULT_, READER_, ADVICE_, AROUND_, SMALL_, STUFF_, DUMMY_, PUT_, HERE_, PUBLISH_, FILLING_ = (1 << i for i in range(len(_SAYS)))
_MEANS: dict[str, int] = {}
for _bit, _list in (
    (TECH_, TECH), (ENABLE_, ENABLE), (NEED_, NEED), (OFF_, OFF), (WITHOUT_, WITHOUT), (NOT_, NOT), (THING_, THING), (DONE_, DONE), (STATE_, STATE), (BEEN_, BEEN), (IS_, IS), (FAULT_, FAULT), (READER_, READER), (ADVICE_, ADVICE),
    (AROUND_, AROUND), (SMALL_, SMALL), (STUFF_, STUFF), (DUMMY_, DUMMY), (PUT_, PUT), (HERE_, HERE), (PUBLISH_, PUBLISH), (FILLING_, AROUND_FILLER),
):
    for _w in _list.split():
        _MEANS[_w] = _MEANS.get(_w, 0) | _bit
for _w in list(_MEANS):  # also as typed without accents
    _MEANS.setdefault("".join(c for c in normalize("NFD", _w) if not combining(c)).replace("ł", "l"), _MEANS[_w])
_TELLS = frozenset(TELLING.split())
_ONLY_FILLER = STUFF_ | DUMMY_ | PUT_ | HERE_ | PUBLISH_ | FILLING_
#: Words that may stand in a message before two of them are joined.
_KNOWN = frozenset(_MEANS) | frozenset("turn turning turned switch switching switched sign signed log logged time timed longer active java support re ve ll doesn couldn isn aren wasn weren don didn hasn haven won wouldn".split()) | frozenset("abcdefghijklmnopqrstuvwxyz")
#: One of them stands in every message.
_ANCHORS = frozenset(w for w, m in _MEANS.items() if m & (TECH_ | ENABLE_ | OFF_ | NOT_ | STATE_ | BEEN_ | FAULT_ | ADVICE_ | STUFF_ | DUMMY_ | PUT_)) | frozenset(
    "t browser prohlížeč przeglądarka navigateur navegador permission permissions many sign signed log logged time timed construction coming written announced completed defined determined added supplied".split()
)
_JOINED = tuple((re.compile(p), r) for p, r in JOINED)
_UNSPACED = tuple((k, re.compile(p)) for k, p in UNSPACED)
_PAST, _PRESENT = frozenset("was were had".split()), frozenset("is are has have does do can cannot will exist exists".split())
_WEAK = tuple(frozenset(w.split()) for w in (
    "try again", "go back", "check address", "check url", "check link", "check connection", "contact support", "contact administrator", "contact operator", "contact us", "reload page", "refresh page", "goes on", "persists", "a mistake", "zkuste později",
    "zkuste znovu", "erneut versuchen", "prüfen adresse", "später versuchen", "spróbuj ponownie", "spróbuj później", "inténtelo nuevo", "réessayez", "riprova", "tente novamente",
))
_TO = frozenset("to for aby pro um für pour para per".split())
_DENIES = frozenset("permission permissions authorized authorised authentication credentials".split())
_OCCURS = frozenset("occurred occurs happened went encountered experiencing technical network application page request script plugin survenu returned response gateway aufgetreten došlo wystąpił ocurrió survenue verificato ocorreu internal fatal unexpected unknown server connection database loading processing rendering establishing trying".split())


def mask(sentence: str) -> str:
    """Lower case, single blanks, and one sign for each address, identifier, date and number."""
    s = _IDENT.sub("#", _ADDRESS.sub("@", sentence.lower()))
    return " ".join(_NUMBER.sub("0", s).split())


def _says(words: list[str], has: int, numbered: bool) -> str | None:
    """The kind of message that the words of a sentence make, whatever else it holds."""
    own = set(words)
    if has & TECH_ and has & (ENABLE_ | NEED_ | OFF_ | WITHOUT_ | NOT_) or has & ENABLE_ and (has & READER_ and has & ADVICE_ or has & THING_ and has & DONE_ and words[0] in _TO):
        return "script notice"
    if not own.isdisjoint(("browser", "prohlížeč", "przeglądarka", "navigateur", "navegador")) and (has & (OFF_ | NOT_) or not own.isdisjoint(("update", "upgrade", "checking", "aktualisieren", "upgraden", "outdated"))):
        return "script notice"
    if has & PUT_ and has & STUFF_ and has & HERE_ or has & DUMMY_ and has & (STUFF_ | PUT_ | THING_) or has & PUT_ and has & PUBLISH_:
        return "filler"
    if has & PUT_ and has & STUFF_ and own >= {"your", "own"} or has & DUMMY_ and len(words) <= 2 and all(w in _MEANS for w in words):
        return "filler"
    if has & STUFF_ and has & HERE_ and has & READER_ and len(words) <= 5 or own >= {"coming", "soon"} and len(words) <= 4:
        return "filler"
    if own >= {"under", "construction"} and len(words) <= 6 or own >= {"to", "be"} and len(words) <= 5 and not own.isdisjoint(("written", "announced", "completed", "defined", "determined", "added", "supplied")):
        return "filler"
    if has & PUT_ and has & STUFF_ and "this" in own and len(words) <= 4:
        return "filler"
    about = has & (THING_ | READER_) or numbered or len(words) <= 3 or words[0] in ("we", "our")
    if about and (has & STATE_ or _follows(words, NOT_, DONE_, 5) or _follows(words, IS_, BEEN_, 3) or has & READER_ and _follows(words, NOT_, THING_, 3) or has & THING_ and _MEANS.get(words[0], 0) & BEEN_ or len(words) <= 4 and has & BEEN_ and has & (THING_ | AROUND_) and not _MEANS.get(words[-1], 0) & SMALL_ or has & (NOT_ | NEED_) and not own.isdisjoint(_DENIES)):
        return "error page"
    if has & FAULT_ and has & THING_ and 1 < len(words) <= 4:
        return "error page"
    if has & FAULT_ and len(words) > 1 and not own.isdisjoint(_OCCURS) or own >= {"too", "many", "requests"}:
        return "error page"
    if has & READER_ and not own.isdisjoint(("captcha", "human", "robot", "bot")) and has & ADVICE_:
        return "error page"
    if "signin" in own and has & READER_ and has & (ADVICE_ | THING_ | DONE_ | NEED_):
        return "error page"
    return None


def _follows(words: list[str], first: int, second: int, reach: int) -> bool:
    """Whether a word that says the second stands at one that says the first or within ``reach`` words after it."""
    left = 0
    for w in words:
        means = _MEANS.get(w, 0)
        if means & first:
            left = reach + 1
        if left and means & second:
            return True
        left -= left > 0
    return False


def judge(masked: str) -> tuple[str | None, bool] | None:
    """(kind, sure) of a masked sentence that reads as a message of a page; kind None and not sure where only advice or a code is given.

    A message is told by what its words say together (see ``_says``) and by how few
    of them say anything else: a page speaks in a small vocabulary, people who
    write about one use other words too. Speaking to the reader allows more other
    words, telling what happened fewer. What is not sure must recur widely.
    Single letters, numbers and masked signs are no words, a quotation is one other word. No length decides.
    """
    if _DENSE.search(masked):
        kind = next((k for k, p in _UNSPACED if p.search(masked)), None)
        return (kind, True) if kind else None
    for pattern, one in _JOINED:
        masked = pattern.sub(one, masked)
    words = [w for w in _WORD.findall(masked) if len(w) > 1 or w in "ai"]
    if not words:
        return None
    has, unknown = 0, masked.count("‘’")
    for w in words:
        means = _MEANS.get(w, 0)
        has |= means
        unknown += 0 if means else 1
        unknown += w in _TELLS
    kind = _says(words, has, "0" in masked or "#" in masked)
    if kind != "filler":  # words of filler are foreign to the other messages
        unknown += sum(1 for w in words if (m := _MEANS.get(w, 0)) and not m & ~_ONLY_FILLER)
    share = unknown / len(words)
    if kind is None:
        own = set(words)
        weak = has & FAULT_ and "0" in masked or any(w <= own for w in _WEAK)
        return (None, False) if weak and not unknown else None
    told = not (_PAST.isdisjoint(words) or has & READER_ or words[0] == "there" or _follows(words, NOT_, DONE_, 5)) and _PRESENT.isdisjoint(words)
    direct = has & READER_ or _MEANS.get(words[0], 0) & (ENABLE_ | PUT_ | DUMMY_)
    sure = not told and (share <= (DIRECT if direct else PLAIN) or unknown <= 1 and len(words) > 2)
    return (kind, sure) if sure or share <= (PAST if told else WIDE_DIRECT if has & READER_ else WIDE_PLAIN) else None


def _filler_words(ws: list[str]) -> bool:
    """A stretch of dummy Latin, one word over and over, or keys struck at random, anywhere in the words of a sentence."""
    if len(ws) < 3:
        return False
    if len(set(ws)) == 1 or set("".join(ws)) == {"x"}:
        return True
    # best stretch of dummy words, by 3 for each dummy word and -7 for another: more than 0.7 of the words are dummy words
    score = held = 0
    seen: set[str] = set()
    for w in ws:
        if w in _LATIN:
            score, held = score + 3, held + 1
            seen.add(w)
            if held >= LATIN_WORDS and len(seen) >= LATIN_WORDS - 1 and not seen <= _ENGLISH:
                return True
        elif score:
            score -= 7
            if score <= 0:
                score = held = 0
                seen.clear()
    if not _LATIN.isdisjoint(ws[:3]):
        return len(ws) >= 4 and sum(w in _LATIN for w in ws) >= 0.7 * len(ws)
    if len(ws) < 4:
        return False
    if _KEYS.issuperset(ws[0]) and _KEYS.issuperset(ws[1]) and _KEYS.issuperset(ws[2]):
        vowels = sum(c in "ae" for w in ws for c in w)
        return all(_KEYS.issuperset(w) for w in ws) and vowels < 0.34 * sum(map(len, ws))
    return len(ws) >= 6 and _ROWS.issuperset(ws)


def _own(lines: list[str]) -> Iterator[str]:
    """The sentences of each line on its own, without those that run on over its edges."""
    for i, line in enumerate(lines):
        pieces = _SENTENCE.split(line)
        goes_on = i + 1 < len(lines) and lines[i + 1][:1].islower() and line[-1:] not in _STOPS
        began = i and line[:1].islower() and lines[i - 1][-1:] not in _STOPS
        yield from pieces[bool(began) : len(pieces) - bool(goes_on)]


def messages(text: str) -> Iterator[tuple[str, str | None, bool]]:
    """(masked sentence, kind, sure) of the sentences of a text that could be residue.

    Code and quoted words do not count as the document's own content, however long.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "`" in text:
        text = _TICKS.sub(" ‘’ ", text)
    if '"' in text or "“" in text or "„" in text:
        text = _QUOTED.sub(" ‘’ ", text)
    opened = _OPEN.search(text) is not None
    for block in text.split("\n\n"):
        lines = [_PREFIX.sub("", line) for line in block.split("\n")]
        sentences = dict.fromkeys(_SENTENCE.split(" ".join(lines)))
        if len(lines) > 1:
            sentences |= dict.fromkeys(_own(lines))
        for sentence in sentences:
            if opened and _OPEN.search(sentence) and (PLACEHOLDER.search(sentence) or CAPITALS.search(sentence)):
                yield mask(sentence), "placeholder", True
                continue
            words = _WORD.findall(sentence.lower())
            if _filler_words(words):
                yield mask(sentence), "filler", True
                continue
            own = set(words)
            unknown = len(own - _KNOWN)
            if (own.isdisjoint(_ANCHORS) or unknown > 1 and unknown > WIDE_DIRECT * len(own)) and not _DENSE.search(sentence):
                continue  # more other words than any message may have
            found = judge(mask(sentence))
            if found:
                yield mask(sentence), *found


PASSAGES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("sure", T.BooleanType()),
])
_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("hash", pa.string()), ("message", pa.string()), ("kind", pa.string()), ("sure", pa.bool_())])


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, hash, message, kind, sure): the distinct suspicious masked sentences of each document, in one map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                for m, kind, sure in sorted(set(messages(t)), key=str):
                    rows.append((k, s, md5(m.encode("utf-8", "replace"), usedforsecurity=False).hexdigest(), m, kind, sure))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    docs = documents.where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return docs.mapInArrow(run, PASSAGES)


def groups(found: DataFrame) -> DataFrame:
    """(hash, documents, sources): equal masked messages over all documents and sources, a null source being one."""
    # sources are first counted apart, so that one message in a third of all documents is summed before it moves
    by_source = found.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("documents"))
    return by_source.groupBy("hash").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("sources"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, message, documents, sources): the residue that stands as content in each document.

    Kinds: placeholder, filler, error page, script notice, and recurring message
    (advice and codes that such pages give). ``documents`` and ``sources`` tell in
    how many the same masked message stands. A message that its words settle counts
    wherever it stands; another one only where it stands in at least
    WIDE_DOCUMENTS documents of WIDE_SOURCES sources. Null, empty and blank texts
    hold none; code and quotations do not count; a null source is one source;
    repeated rows give repeated rows; an empty table gives an empty result; other
    columns are ignored.

    Plan: one map over the scan masks the sentences and keeps those that read as a
    message; they are written once, and only they are shuffled. Hashes of equal
    masked messages are grouped over all documents and sources with partial sums
    per source, and return to the documents, the hot ones by broadcast: a group
    above 1/200 of the rows is one of at most 200.
    """
    found, seen = Scratch(documents.sparkSession, "residue").save(passages(documents), n=F.count(F.lit(1)))
    told = lookup(found, "hash", groups(found), seen["n"] or 0)
    wide = (F.col("documents") >= WIDE_DOCUMENTS) & (F.col("sources") >= WIDE_SOURCES)
    return told.where(F.col("sure") | wide).select("doc_id", F.coalesce("kind", F.lit("recurring message")).alias("kind"), "message", "documents", "sources")
