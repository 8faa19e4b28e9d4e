"""Texts for the residue operator, one a line, written after the first rules, on which recall was then 0.80.

The vocabulary was widened afterwards by someone who knew these texts, so the later
figure is not a blind one; that is the figure of ``residue_fresh.py``.
"""

RESIDUE = """\
Hey there! This website uses JavaScript. Turn it on to see everything we have to offer.
Heads up: some features are unavailable because JavaScript is switched off.
Sorry, our store needs JavaScript.
JavaScript is not enabled in this browser.
To use this form, JavaScript must be allowed.
You must have JavaScript enabled to use this form.
Please make sure JavaScript is enabled.
Your browser has scripting disabled or does not support it.
This video player requires Flash or HTML5 support in your browser.
Please upgrade your browser to improve your experience.
You are using an outdated browser.
We've detected that JavaScript is disabled. Please enable it or switch to a supported browser.
Loading... If this takes too long, check that JavaScript is enabled.
The chart cannot be displayed without JavaScript.
Comments are loaded with JavaScript. Please enable JavaScript to read them.
Allow cookies to continue.
Your browser is blocking cookies. Please change your settings.
Please enable third-party cookies to sign in.
This application requires cookies to be enabled.
Please verify you are human. Enable JavaScript and cookies to proceed.
One moment, we are checking your browser.
Diese Seite benötigt JavaScript.
Ihr Browser unterstützt kein JavaScript.
Bitte schalten Sie JavaScript ein.
Sie müssen Cookies akzeptieren, um fortzufahren.
Prosím zapněte JavaScript ve svém prohlížeči.
Bez JavaScriptu tato aplikace nefunguje.
Aby wyświetlić tę stronę, włącz obsługę JavaScript.
Twoja przeglądarka nie obsługuje JavaScript.
JavaScript est désactivé dans votre navigateur.
Cette application nécessite l'activation de JavaScript.
Debe habilitar JavaScript para ver esta página.
JavaScript está desactivado en su navegador.
Questo sito richiede JavaScript.
Você precisa habilitar o JavaScript para usar este site.
JavaScriptが無効になっています。有効にしてください。
您的浏览器不支持JavaScript，请启用JavaScript。
For the best experience please turn JavaScript on.
Scripts are blocked. Please allow scripts for this site.
This web page uses scripts which your browser does not allow.
Sorry, we can't find that page.
The page you are trying to reach does not exist.
Whoops, looks like this page doesn't exist.
404. That's an error. The requested URL was not found on this server. That's all we know.
HTTP Error 404. The requested resource is not found.
Not Found. The requested URL /index.php was not found on this server.
File not found
We're sorry, the page you have requested cannot be found.
Uh oh, this link is broken.
The product you are looking for is no longer available.
This item is no longer available.
This post has been removed.
This page has moved.
The article you requested is not available.
Video not found
User not found
This listing has been deleted.
Sorry, this content isn't available right now.
Oh no! Something went wrong on our end.
An error has occurred. Please refresh the page.
We are experiencing technical difficulties. Please try again later.
Error: Unable to load page.
Unexpected error. Contact support if the problem persists.
There was a problem loading this page.
There was an error processing your request.
Your request could not be processed. Please try again.
The server is not responding.
Server error. Please try again later.
Error 500. The server could not complete your request.
HTTP 503 Service Unavailable
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
The upstream server returned an invalid response.
Connection refused
Connection reset by peer
Network error. Check your connection and reload.
Unable to reach the server. Please check your internet connection.
The operation timed out.
Request timed out.
Gateway timeout
This site is currently unavailable.
We'll be back soon! Our website is undergoing maintenance.
Down for maintenance. Check back shortly.
Access forbidden!
You do not have permission to view this directory or page.
You need permission to access this document.
Unauthorized access. Please sign in.
You must be logged in to view this content.
Please sign in to view this page.
Session timed out. Please log in again.
Invalid session. Please sign in again.
Your IP address has been blocked.
Request blocked. Please contact the site owner.
You have exceeded your request limit. Please wait a moment and try again.
Rate limit exceeded
Your account has been disabled.
Fatal error: uncaught exception.
Warning: Cannot connect to the database server.
Database error
The image could not be loaded.
The file you requested has been deleted.
This document could not be displayed.
Dieses Video ist nicht verfügbar.
Diese Seite existiert nicht.
Die Seite ist derzeit nicht erreichbar.
Leider ist ein Fehler aufgetreten.
Ihre Sitzung ist abgelaufen.
Stránka, kterou hledáte, neexistuje.
Server je dočasně nedostupný.
Přístup odepřen.
Vaše relace vypršela.
Strona nie została znaleziona.
Serwer jest niedostępny.
Dostęp zabroniony
Erreur 404 : page non trouvée
Accès refusé
Une erreur est survenue. Veuillez réessayer plus tard.
Acceso denegado
Ha ocurrido un error. Inténtelo de nuevo más tarde.
Accesso negato
Errore del server
Erro interno do servidor
ページを表示できません。
サーバーエラーが発生しました。
服务器内部错误
Sed ut perspiciatis: lorem ipsum dolor sit amet, consectetur adipiscing elit.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Curabitur lorem ipsum, vel sagittis velit mauris nec tortor.
About us - Lorem ipsum dolor sit amet, sed do eiusmod tempor incididunt ut labore.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Your headline here
Your paragraph goes here.
Description goes here.
Subtitle goes here
Enter your text here...
Insert content here
Insert image here
Add a title here
Write your bio here.
Some placeholder content.
Dummy text for layout purposes.
This is a placeholder page.
Sample content, please replace.
Please replace this placeholder before publishing.
Type something here
Change this text.
Under construction
To be written.
Beispieltext, bitte ersetzen.
Fülltext
Text bude doplněn.
Tady bude popis.
Przykładowy tekst
Texte de remplissage
Texto de ejemplo
サンプルテキスト
foo foo foo foo foo
Test. Test. Test test test.
qwer asdf qwer asdf qwer asdf
xxxxx xxxx xxx xxxxx
Dear [Client's Name], we are pleased to confirm your booking.
Hi [First Name], just checking in on our last conversation.
Dear Hiring Manager, I am excited to apply for the [Position] role at [Company Name].
Hello {{customer.first_name}}, your subscription renews soon.
Hello {user_name}! You have a new follower.
Dear ${firstName} ${lastName},
Kind regards, [Your Name] [Your Position]
Call us on [Phone Number] for a quote.
Our headquarters are in [City], [Country].
This Lease is between [Landlord Name] and [Tenant Name].
The Seller agrees to pay [AMOUNT IN WORDS] dollars.
Effective as of [Insert Date]
<Your Company Name> is hiring.
Visit %%website%% for more.
{{> header}} {{title}} {{> footer}}
{% if user %} Welcome {{ user.name }} {% endif %}
<%= user.name %> commented on your post.
Hi *|FNAME|*! We have news.
Good morning, <<Name>>.
Your verification code is {{code}}.
Your order %ORDER_ID% has been placed.
Welcome to [WEBSITE NAME].
Last updated: [Month Day, Year]
[Add your mission statement here]
[Write one paragraph about your goals]
[Describe the problem here]
Signature: ____________________
Phone: [your phone number]
Item: {0}, quantity: {1}
Created by {author} on {date}
Dear [Recipient's Name],
Re: [Subject]
Event: [Event Name] Venue: [Venue]
Liebe/r [Vorname], danke für Ihre Bestellung.
Dobrý den, [jméno], děkujeme za objednávku.
Drogi [imię], dziękujemy za zakupy.
Bonjour [prénom], votre commande est prête.
Hola [nombre], tu pedido está listo.
Ciao [nome], il tuo ordine è pronto.
Hello [object Object]
Your balance is {{ balance }}.
Date of birth: DD/MM/YYYY
Replace [COMPANY] with the name of your company.
""".splitlines()

LOOKALIKES = """\
JavaScript runs in every major browser and on many servers.
The course teaches HTML first and JavaScript in the second month.
Last year the agency rewrote its scripts in another language.
My grandmother keeps her cookies in a blue tin.
Most shops ask before they store cookies on a visitor's computer.
The playwright delivered two scripts to the theatre in spring.
Disabling scripts broke the map on the council's page, residents complained.
The library's terminals block cookies for privacy, the director explained.
Several readers asked why our newsletter works without JavaScript.
According to the report, half of the sites required cookies.
He learned JavaScript because his company needed a booking form.
The browser wars ended around 2001.
A script is a set of written characters, such as Cyrillic.
The engine compiles JavaScript to machine code while the program runs.
Our designers checked the page in four browsers.
The judge allowed the cameras in the courtroom.
The pilot switched on the lights and switched off the engine.
Flash floods closed the road between the villages.
The chef needs butter, sugar and flour for the cookies.
The script supervisor notes every change on the set.
Der Drehbuchautor hat das Skript in Wien geschrieben.
Im Browser der Bibliothek sind nur wenige Seiten erlaubt, erklärt die Leiterin.
Herec dostal scénář až v den natáčení.
Przeglądarka zdjęć w muzeum pokazuje zbiory z XIX wieku.
Le navigateur portugais atteignit la côte en 1500.
El navegador italiano llegó a la isla en octubre.
ブラウザの歴史は三十年ほどである。
They turned on the heating in October because the nights were cold.
Support for the strike grew during the week.
The old mill requires a new roof, which the village cannot afford.
The requirement that candidates speak two languages was dropped.
Volunteers enabled the festival to run for thirty years.
The act enables cities to tax empty flats.
The update to the timetable takes effect in December.
Checking the brakes takes about an hour.
The expedition could not find the wreck in 2009.
The lost page turned up in a private collection.
No trace of the ship was ever found.
A page from the diary is on display in the entrance hall.
The document was found under the floor of the chapel.
The site of the battle is marked by a stone cross.
Archaeologists could not access the site during the war.
The error cost the bank four million euros.
The error bars show one standard deviation.
A common error is to confuse mass with weight.
An error in the ballot led to a second vote.
The problem was solved by a student in 1976.
There was a problem with the brakes, so the race began an hour late.
The server dropped a tray of glasses.
The tennis player is a strong server and rarely loses.
The waiter served the soup and apologised for the delay.
The bus service is not available on Sundays, according to the operator's timetable.
Water was unavailable in parts of the town for two days.
The drug is no longer produced in Europe.
The bird no longer breeds in the south of the island.
The law no longer applies to small farms.
The bridge was closed for maintenance in the summer of 2018.
The maintenance crew repaired the lift.
Doctors were denied entry to the camp.
The senator denied the claims and blamed the press.
Parking is forbidden in front of the fire station.
Fishing is forbidden on the eastern shore.
It is forbidden to feed the bears.
The permit expired in 2011 and the mine closed.
The treaty expires in ten years.
Their lease had expired, and the family moved to the coast.
The match timed out with the score level.
The coach called a time out with a minute left.
The gateway drug theory is disputed.
Bad weather delayed the gateway's assembly at the space station.
The connection was lost during the storm and the captain used a lamp.
Her connection to the village goes back to her childhood.
The database contains records of two million births.
A request for more teachers was sent to the ministry.
The request was refused twice before the minister gave in.
The account in the chronicle differs from the letters.
He opened an account at the savings bank.
The session ended with a vote on the budget.
The session lasted until midnight because of the amendments.
The log shows that the client sent the same request nine times.
Status 403 tells the client that the server understood the request but refuses it.
The monitoring page turns red when a gateway stops answering.
In our test the proxy returned error 502 in three of a thousand requests.
We fixed the bug that showed "Something went wrong" after every upload.
The phrase "access denied" is the title of his second novel.
The artist printed error messages on silk.
Users saw an error page for nine minutes while the team restored a backup.
The exhibit about failed software includes a famous blue screen.
A missing semicolon caused the failure, as the engineers explained.
The manual says what to do if a file cannot be opened.
When the disk is full, the program writes nothing and exits with code 3.
The retry policy waits two seconds before the second attempt.
The village was removed from the map when the lake was filled.
The statue was moved to the park in 1962.
The scene was deleted from the final cut.
Reporters were blocked from the hearing.
The road is blocked by a fallen tree.
The user of the telescope must warm up the mirror first.
The product of two odd numbers is odd.
The item that sold for most was a clock.
The video was filmed in one take.
The list of victims has not been published.
The results could not be repeated by other laboratories.
The village shop could not compete and closed.
The letter could not be delivered because the house had burned down.
The patient could not be reached by phone.
The plane could not land because of fog.
Der Schlüssel konnte erst nach Tagen gefunden werden.
Der Dienst am Kunden steht im Vordergrund, sagt die Inhaberin.
Die Verbindung zwischen den Inseln wurde 1932 eingestellt.
Soubor budov tvoří jádro památkové rezervace.
Stránka z deníku visí ve vstupní hale.
Služba v kostele začíná v deset hodin.
Strona internetowa gminy ma nowy wygląd od maja.
Połączenie kolejowe między miastami działa od 1899 roku.
La page de garde porte la signature du roi.
Une erreur de calcul a retardé le chantier.
La página está escrita a mano por el poeta.
Un error de traducción cambió el sentido del tratado.
La pagina del diario è esposta nel museo.
O servidor público trabalha na prefeitura.
誤りを認めた市長は謝罪した。
Too many visitors climb the hill in summer.
Many requests for help came from the islands.
Please return the books to the desk by Friday.
Please bring a warm coat and good shoes to the excursion.
Sorry is the hardest word in the old song.
Please contact the ranger if you see a wolf.
Try the regional cheese with a glass of cider.
Later that year the family moved to Denmark.
Check the oil before a long trip.
Home is where the heart is, as the saying goes.
Contact with the tribe was lost in the 1930s.
The text was translated into Latin in the twelfth century.
The body of the text is set in a narrow typeface.
The heading gives the name of the chapter and the year.
The paragraph on taxes was added by the editor.
The bust is a copy of a lost original.
Copies of the text circulated for two hundred years.
Lorem ipsum appears on the poster as a joke of the designer.
Designers fill empty boxes with lorem ipsum until the copy arrives.
In the Aeneid the hero tells of Troy: quorum pars magna fui.
The motto of the city is Fluctuat nec mergitur.
He studied the morphology of Veronica and Salix in the Alps.
The mass ended with Ite missa est.
Homo sapiens reached the island about five thousand years ago.
The sample contains traces of lead.
Sample sizes differ between the groups.
The dummy in the window wore a green coat.
The baby spat out its dummy and cried.
Placeholders in the query plan are bound before execution, the paper notes.
The temporary bridge is a placeholder until the new one opens.
The construction site is next to the school.
The tunnel has been under construction since 2015.
A cathedral was under construction when the plague came.
The tests are written by the teachers of the school.
The remaining chapters were never written.
The word goes back to a Norse root.
The prize goes to a novelist from Ghana.
The story goes that a shepherd found the cave.
The river enters the sea here.
Here the road divides and the left branch climbs to the pass.
Write to me when you arrive.
Change trains at the next station.
Add the onions and stir for five minutes.
Type specimens of the beetle are kept in Paris.
Replace the lid and simmer for an hour.
Describe the smell of rain, the teacher asked.
Der Text der Hymne stammt aus dem Jahr 1841.
Die Probe wurde bei minus zwanzig Grad gelagert.
Text písně napsal básník v roce 1938.
Popis cesty najdete v průvodci.
Tekst pieśni powstał w 1910 roku.
Le texte original a été perdu.
El texto se conserva en la catedral.
Il testo è scritto su pergamena.
サンプルは三つの川から採取された。
Section [4] describes the apparatus.
The value lies in [0, 10].
"We [the workers] want bread," the leaflet said.
The editor wrote [sic] after the misspelled name.
See [the appendix](#appendix) for the names.
[Home](https://example.org) | [Contact](https://example.org/contact)
[wiki]: https://example.org/wiki
[[Prague]] is the capital of the Czech Republic.
Use `%s` to format a string.
The pattern `<name>` in the grammar stands for an identifier.
The syntax "${HOME}" expands to the home directory.
The sequence {1, 4, 9, 16} consists of squares.
If x < 3 and y > 4 the point lies outside.
Sales rose by 12% and costs by 3%.
He paid $3 for coffee and $4 for cake.
The hashtag #metoo spread in 2017.
The method __len__ gives the size.
Wait... did you hear that?
- [ ] water the plants
The name of the rose is a novel.
The date of the founding is disputed.
The address was given in Latin by the dean.
Insert cards were printed for the jubilee edition.
Your name is an old one, she told him.
The phone number of the clinic is 555 0199.
The signature on the will was forged.
The title of the film was changed before the premiere.
The first name on the list was crossed out.
Order number 66 appears in the third film.
The company, city and year are engraved on the bell.
Subject and object can change places in Czech.
The venue holds two thousand people.
```
Error 500: {{ message }}
```
""".splitlines()
