"""Linking variant spellings of person and organisation names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, groupby, islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loomstone.llm import components
from loomstone.llm.blocks import batched
from loomstone.operators.skew import lookup
from loomstone.runtime import Scratch

#: Jaro-Winkler similarity from which two words of at least LONG letters are spellings of one, and that of words with equal phonetic codes.
CLOSE, SOUNDS = 0.88, 0.75
LONG = 5
#: Share of the telling words of two profiles, of all they have, from which they agree.
AGREE = 0.6
#: Members above which those of a block are compared only where their other words can match, and above which it is cut by these words over many tasks.
FEW, LARGE = 16, 500

# --- fixed values ---------------------------------------------------------------------------------------------------
#: Given names and their short and pet forms.
NICKNAMES = {
    "aaron": "ron ronnie", "abigail": "abby gail", "alan": "al", "albert": "al bert bertie", "alena": "alenka lena", "alexander": "alex sasha sandy xander aleks",
    "alexandra": "alex sandra sasha", "alfred": "alf fred alfie", "alois": "lojza", "amanda": "mandy", "andrew": "andy drew", "angela": "angie", "anna": "ann annie anicka nan",
    "anton": "toni tonda tony", "arthur": "art artie", "barbora": "bara barb barbara babs", "beata": "bea", "benedikt": "ben benny bene", "benjamin": "ben benji benny",
    "bernard": "bernie", "bohdan": "bob dan", "bradley": "brad", "bridget": "biddy bridie", "calvin": "cal", "caroline": "carrie caro lina", "catherine": "cathy kate katie kitty cat",
    "cecilie": "cilka celia cile", "charles": "charlie chuck chaz karel carl", "charlotte": "lottie charlie lotta", "christian": "chris", "christina": "chris tina chrissy christine",
    "christof": "chris kit", "christopher": "chris topher kit", "clara": "klara", "clifford": "cliff", "cynthia": "cindy", "dagmar": "dasa", "daniel": "dan danny", "david": "dave",
    "deborah": "deb debbie", "dennis": "denny", "dominik": "dom nick", "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edgar": "ed eda",
    "edita": "edith edie", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora lea", "elias": "eli", "elizabeth": "liz lizzie beth betty eliska lisa bess", "emil": "milek",
    "emily": "em emmy", "ester": "hester essie", "eugene": "gene", "eva": "evicka eve", "ferdinand": "ferda ferdi", "filip": "phil philip", "frances": "fran fanny frankie",
    "francis": "frank fran franz", "frederik": "fred freddy fritz", "gabriel": "gabe", "gabriela": "gabi gaby", "george": "georgie jorge", "gerald": "gerry jerry", "gerhard": "gerd",
    "gregory": "greg", "gustav": "gus gusta", "hana": "hanka", "harold": "harry hal", "hedvika": "heda hedy", "helena": "leni helen lenka hela", "henrik": "henry rik",
    "henry": "hank harry hal", "hugo": "huey", "ignac": "nacek iggy", "ilona": "ili", "ingrid": "inga", "isabella": "bella izzy", "ivan": "vanya", "jacqueline": "jackie",
    "jakub": "kuba jacob", "james": "jim jimmy jamie", "jan": "honza john johnny jenda", "jana": "janicka", "jasmin": "jas", "jeffrey": "jeff", "jennifer": "jen jenny jenn",
    "jeremias": "jerry", "jessica": "jess jessie", "jiri": "jirka george", "johana": "hana hanka jo", "johann": "hans johannes", "jonas": "joni", "jonathan": "jon jonny",
    "josef": "pepa joe joseph sepp", "joseph": "joe joey", "joshua": "josh", "judita": "judy jitka", "judith": "judy", "julius": "jul jules", "kamila": "kami camilla",
    "karel": "kaja karlik charles", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "klara": "klarka", "konrad": "kurt con", "kristof": "kris",
    "laura": "laurie lora", "lawrence": "larry lars laurence", "leonard": "leo len lenny", "leopold": "leo poldi", "lidia": "lida lydia", "louis": "lou louie", "ludmila": "lida mila",
    "lukas": "luke luki", "magdalena": "lena magda maggie", "marcel": "marc", "margaret": "maggie meg peggy marge greta", "marie": "mary maruska mimi", "marta": "martha marticka",
    "martin": "marty", "matej": "mates matt", "matthew": "matt matty", "matthias": "matt matti", "maximilian": "max", "michael": "mike mick misa", "milan": "mila", "monika": "moni",
    "nadja": "nada", "natalie": "talia nat nata", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "nikola": "niki", "oliver": "ollie", "ondrej": "ondra andy", "oskar": "ossi",
    "otto": "ota", "pamela": "pam", "patricia": "pat patty tricia trish", "patrik": "pat paddy", "pavel": "paul pavlik", "petr": "peter pete peta", "petra": "peti", "philipp": "phil",
    "radek": "rada", "raymond": "ray", "rebecca": "becky becca", "renata": "rena", "richard": "dick rick ricky rich", "robert": "rob bob bobby bert", "roman": "romek",
    "ronald": "ron ronnie", "rosalie": "rosa rose", "rudolf": "rudi ruda rolf", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sara", "sebastian": "bast seb basti",
    "sigrid": "sigi", "silvie": "silva sylvia", "simon": "sim simi", "sofie": "fia zofie sophie", "stanislav": "standa stan", "stephan": "steve stef stevie", "stephen": "steve steven",
    "susan": "sue susie", "susanna": "sue susi susie zuzana", "tadeas": "tad ted", "tamara": "tami", "terence": "terry", "theodor": "theo ted teddy",
    "theresa": "terry resi tess terezka", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "toby tobi", "ursula": "uschi ulla", "vaclav": "vasek venca", "valentin": "val",
    "valerie": "val", "vera": "verca", "veronica": "ronnie vera", "victor": "vic vick", "victoria": "vicky tori", "viktorie": "viki vicky", "vilem": "vilda", "vincent": "vince vinny",
    "virginia": "ginny", "vladimir": "vlada vova", "vojtech": "vojta", "walter": "walt wally", "wanda": "vanda", "wenzel": "wenz", "wilhelm": "willi helmut",
    "william": "bill will billy willy liam", "xaver": "xav", "yvona": "ivona", "zachar": "zach", "zdenek": "zdena", "zofie": "zofka", "zuzana": "zuzka",
}
TITLES = frozenset("bc csc dipl doc dr frau herr ing judr madam mgr miss mr mrs ms mudr mx pan pani paeddr phd phdr prof rndr sir".split())
PARTICLES = frozenset("af al and av da das de del della der des di do du el et la le les of the und van vom von z za ze zu zum zur".split())
LEGAL = frozenset("a.s ag akciova as asa bv co company corp corporation gmbh inc incorporated kft kg limited llc llp ltd nv ob oy plc pte pty sa sarl se spol sro".split())
GENERATIONS = frozenset("ii iii iv jr junior ml senior sr st".split())
#: Words of profiles that say nothing about the being.
PROFILE_WORDS = frozenset(
    "a about an and as at based branch by contact desk for from handles has head in is known lead leads member mentioned minutes notes of office on person "
    "responsible signs since site staff team the to with works".split()
)
#: Letter groups of one sound, applied in this order to folded words.
SOUNDS_ALIKE = (
    ("tsch", "k"), ("tch", "k"), ("sch", "s"), ("ch", "k"), ("cz", "k"), ("sh", "s"), ("sz", "s"), ("zh", "z"), ("rz", "r"), ("ph", "f"), ("th", "t"), ("ck", "k"),
    ("qu", "kv"), ("x", "ks"), ("c", "k"), ("q", "k"), ("w", "v"),
)
_LIKE = str.maketrans("cqw", "kkv")
_SPECIAL = str.maketrans({"ß": "ss", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})
_LEGAL_DOTS = re.compile(r"\b(?:spol\.? ?s ?r\.? ?o|s\. ?r\. ?o|a\. ?s|sp\. ?z ?o\. ?o|e\. ?v|b\. ?v|n\. ?v|s\. ?a)\b\.?\s*$")
_PART = re.compile(r"([^\W\d_]+|\d+)(\.?)(-?)")
_PET: dict[str, set[str]] = {}
for _name, _forms in NICKNAMES.items():
    for _form in (_name, *_forms.split()):
        _PET.setdefault(_form, set()).add(_name)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower().translate(_SPECIAL)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def profile_key(text: str | None) -> str:
    """The telling words of a profile, sorted; empty if there are none."""
    return " ".join(sorted({w for w in re.findall(r"[^\W\d_]+", fold(text))} - PROFILE_WORDS)) if text else ""


@lru_cache(maxsize=100_000)
def code(word: str) -> str:
    """Phonetic code: sounds of the consonants in order, doubled ones once; words of fewer than two give themselves."""
    w = word
    for group, sound in SOUNDS_ALIKE:
        w = w.replace(group, sound)
    out = ""
    for c in w:
        if c not in "aeiouyj" and not out.endswith(c):
            out += c
    return out if len(out) > 1 else word


def letters(word: str) -> str:
    """The consonants as written but for letters of one sound, for slips that break a letter group or a doubled letter."""
    return "".join(c for c in word.translate(_LIKE) if c not in "aeiouyj")


@dataclass(frozen=True, slots=True)
class Word:
    text: str
    dotted: bool
    compound: int  # words joined by hyphens share a number


@dataclass(frozen=True, slots=True)
class Name:
    words: tuple[Word, ...]
    generation: str

    @property
    def key(self) -> str:
        """Sorted words, the same for any order, title, particle, letter case, accents and legal form."""
        return " ".join(sorted(w.text + "." * (w.dotted and len(w.text) > 1) for w in self.words)) + (f" /{self.generation}" if self.generation else "")


@lru_cache(maxsize=50_000)
def parse(text: str) -> Name:
    folded = _LEGAL_DOTS.sub(" ", fold(text))
    words, generation, compound, joined = [], "", 0, False
    found = _PART.findall(folded)
    for i, (w, dot, hyphen) in enumerate(found):
        compound += not joined
        joined = bool(hyphen)
        if w in TITLES or w in PARTICLES and not dot:
            continue
        if w in GENERATIONS and i and (dot or len(w) > 1) and len(words) > 1:
            generation = {"junior": "jr", "senior": "sr", "ml": "jr", "st": "sr"}.get(w, w)
            continue
        words.append(Word(w, bool(dot), compound))
    while len(words) > 1 and words[-1].text in LEGAL:
        words.pop()
    return Name(tuple(words), generation)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if taken[j])))
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter put in, left out, replaced or swapped with its neighbour turns one word into the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def slips(a: str, b: str, most: int = 2) -> int:
    """Letters put in, left out, replaced or swapped with their neighbour between two words, counted up to ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _gendered(a: str, b: str) -> bool:
    """Two forms of a family name, of a man and of a woman."""
    short, long = sorted((a, b), key=len)
    return long in (short + "ova", short.removesuffix("a") + "ova", short.removesuffix("y") + "a") and short != long and long.endswith(("ova", "ska", "cka"))


@lru_cache(maxsize=100_000)
def _signs(word: str) -> tuple[int, str]:
    """The set of characters as bits, one for each by its number modulo 61, and the phonetic code."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits, code(word)


def _match(a: Word, b: Word) -> int:
    """2: spellings of one word; 1: an initial, abbreviation or short form of the other; 0: neither."""
    x, y = a.text, b.text
    if x == y:
        return 2 if len(x) > 1 else 1
    if len(x) >= LONG and len(y) >= LONG and not (a.dotted or b.dotted or x in _PET or y in _PET):
        (p, sound), (q, other) = _signs(x), _signs(y)
        if sound != other and ((p & ~q).bit_count() > 2 or (q & ~p).bit_count() > 2):
            return 0  # more than two slips, so no rule below holds
    if len(x) == 1 or len(y) == 1:
        return int(x[0] == y[0] or any(n[0] == min(x, y, key=len) for n in _PET.get(max(x, y, key=len), ())))
    if (_PET.get(x, set()) | {x}) & (_PET.get(y, set()) | {y}):
        return 1
    if x in _PET and len(y) > 2 and x.startswith(y) or y in _PET and len(x) > 2 and y.startswith(x):
        return 1
    if (a.dotted and len(x) > 2 and y.startswith(x)) or (b.dotted and len(y) > 2 and x.startswith(y)):
        return 1
    if _gendered(x, y):
        return 0
    if min(len(x), len(y)) >= LONG:
        s = jaro_winkler(x, y)
        close = s >= CLOSE and slips(x, y) <= 2  # a long shared beginning alone is not enough
        return 2 if close or s >= SOUNDS and code(x) == code(y) or min(len(x), len(y)) > LONG and one_slip(x, y) else 0
    if min(len(x), len(y)) >= 3 and not (x in _PET and y in _PET):  # two known names are two names
        return int(one_slip(x, y))
    return 0


def same(a: Name, b: Name, backed: bool = False) -> bool:
    """Whether two names can be spellings of one name; ``backed`` by profiles that agree, a short word with one slip is enough beside an equal one.

    Every whole word of one must match a word of the other, but for one more part
    of a compound; single letters may stand for words or be left out; at least one
    long word must match as a spelling, and two words in all if both names have two.
    """
    if a.generation != b.generation:
        return False
    left = list(range(len(b.words)))
    pairs, loose = [], []
    options = [(m, -abs(i - j), i, j) for i, x in enumerate(a.words) for j, y in enumerate(b.words) if (m := _match(x, y))]
    if len(options) < min(2, len(a.words), len(b.words)) or not any(m == 2 for m, *_ in options):
        return False
    options.sort(reverse=True)
    used: set[int] = set()
    for m, _, i, j in options:
        if i not in used and j in left:
            used.add(i)
            left.remove(j)
            pairs.append((m, a.words[i], b.words[j]))
    loose = [(w, a) for i, w in enumerate(a.words) if i not in used] + [(b.words[j], b) for j in left]
    for w, _ in loose:
        if len(w.text) > 1 and not any(w.compound == v.compound for _, x, y in pairs for v in (x, y) if v is not w and len(v.text) > 1):
            return False
    strong = any(m == 2 and (min(len(x.text), len(y.text)) >= LONG or x.text == y.text and len(x.text) > 2) and not (x.text in _PET or y.text in _PET) for m, x, y in pairs)
    strong = strong or backed and len(pairs) > 1 and any(m == 2 and x.text == y.text and len(x.text) > 3 for m, x, y in pairs)
    return (strong or len(pairs) > 1 and all(m == 2 for m, _, _ in pairs)) and len(pairs) >= min(2, len(a.words), len(b.words))


def agree(p: str, q: str) -> bool:
    """Whether two profiles, as ``profile_key`` gives them, are equal but for at most one telling word of each, and share AGREE of all they have."""
    return p == q or bool(p and q) and _near(p, q)


@lru_cache(maxsize=100_000)
def _near(p: str, q: str) -> bool:
    a, b = set(p.split()), set(q.split())
    return len(a - b) <= 1 and len(b - a) <= 1 and len(a & b) >= AGREE * len(a | b)


def profile_forms(profiles: DataFrame) -> DataFrame:
    """(profile, besides): for each distinct profile the numbers of its word set, whole and with one word left out, under which agreeing profiles meet.

    The whole set always stands; a set with a word left out only if another profile
    has it too, and is it as a whole or has at least four words itself. A number is
    the exclusive or of the words' hashes, so it takes one step a word.
    """
    each = profiles.select("profile").distinct().withColumn("h", F.transform(F.filter(F.split("profile", " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
    each = each.withColumn("all", F.aggregate("h", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))).withColumn("n", F.size("h"))
    less = F.when(F.col("n") >= 3, F.transform("h", lambda x: F.struct(F.col("all").bitwiseXOR(x).alias("form"), F.lit(False).alias("whole")))).otherwise(F.array().cast("array<struct<form:bigint,whole:boolean>>"))
    forms = each.select("profile", "n", F.inline(F.concat(F.array(F.struct(F.col("all").alias("form"), F.lit(True).alias("whole"))), less)))
    forms, seen = Scratch(profiles.sparkSession, "forms").save(forms, rows=F.count(F.lit(1)))
    # partial sums before the shuffle: a form of very many profiles is one row a task
    met = forms.groupBy("form").agg(F.count(F.lit(1)).alias("k"), F.bool_or("whole").alias("any"), F.max("n").alias("most")).where("k > 1 and (any or most > 3)").select("form", F.lit(True).alias("met"))
    kept = lookup(forms, "form", met, seen["rows"] or 0, "left").where("whole or met")
    return kept.groupBy("profile").agg(F.collect_set("form").alias("besides"))  # at most one more than the profile has words


def _left_out(sound: str) -> Iterator[str]:
    """A code with one sound left out, and the code itself, which others may come down to."""
    yield from (f"{sound[:i]}{sound[i + 1 :]}~" for i in range(len(sound)))
    yield f"{sound}~"


def block_keys(name: Name, besides: list) -> set[tuple[str, str, int]]:
    """(block, origin, word): the phonetic code and the consonants of each long word, whole and with one left out, beside each form of the profile.

    ``origin`` tells what a sound was left out of, empty for whole codes, so that
    words of one origin are not compared in all its blocks; ``word`` is the number
    of the word. Names without a profile have no more in their blocks: the other
    words may be short forms, initials or misspelt from their first letter on.
    """
    words = [w for w in name.words if len(w.text) > 1 and not (w.dotted and len(w.text) < LONG)]
    long = [w for w in words if len(w.text) >= LONG and w.text not in _PET] or words or list(name.words)
    keys = set()
    for i, w in enumerate(name.words):
        if w in long:
            both = {code(w.text), letters(w.text)}
            for beside in besides:
                for s in both:
                    keys.add((f"{beside}|{s}|", "", i))
                    keys.update((f"{beside}|{c}", s, i) for c in _left_out(s))
    return keys


def finer_keys(name: Name, word: int) -> set[tuple[str, str]]:
    """(part, origin): where a name stands within a large block that its ``word`` shares with too many, by all its other words.

    Two names of the block that ``same`` accepts match in another word as well, if
    both have one: by sound, with one sound left out, by a common full form, as a
    beginning, or as an initial or abbreviation. Whole words meet initials, but not
    each other, in the parts of initials; single letters may be left out.
    """
    others = [w for i, w in enumerate(name.words) if i != word]
    keys = {("only", "")} if all(len(w.text) == 1 for w in others) else set()
    for w in others:
        if len(w.text) == 1 or w.dotted:
            keys.add((f"i{w.text[0]}", ""))
        for full in _PET.get(w.text, set()) | {w.text} if len(w.text) > 1 else ():
            sound = code(full)
            keys |= {(f"c{sound}", ""), (f"b{full[:3]}", ""), (f"i{full[0]}", "whole"), *((f"l{c}", sound) for c in _left_out(sound))}
            keys |= {(f"s{c}", full) for c in _left_out(full)} if len(full) < LONG else set()
    return keys


def _digest(text: str) -> int:
    """A 64-bit number for a block, which is all that the shuffle carries of it."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


NODES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "name", "name_key", "profile")])
_KEYS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("origin", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("node", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("profile", T.StringType()),
])
#: A pair of nodes, or (b null) a member of a block too large to be compared as a whole.
_PAIRS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), *[f for f in _KEYS if f.name not in ("node", "origin")]])
_KIND = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
_ARROW = {k: pa.schema([(f.name, _KIND[f.dataType]) for f in s]) for k, s in (("nodes", NODES), ("keys", _KEYS), ("pairs", _PAIRS))}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for i, kind, name, profile in _rows(batches):
            key = parse(name).key
            if key:
                yield i, kind, name, key, profile_key(profile)

    yield from batched(rows(), _ARROW["nodes"])


def _origin(text: str) -> int:
    return crc32(text.encode()) & 0x7FFFFFFF if text else 0


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for node, name, profile, besides in _rows(batches):
            for block, c, word in sorted(block_keys(parse(name), besides)):
                yield _digest(block), _origin(c), word, node, name, profile

    yield from batched(rows(), _ARROW["keys"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large blocks to their parts."""

    def rows() -> Iterator[tuple]:
        for node, block, word, name, profile in _rows(batches):
            for part, c in sorted(finer_keys(parse(name), word)):
                yield _digest(f"{block}|{part}"), _origin(c), word, node, name, profile

    yield from batched(rows(), _ARROW["keys"])


def _compared(batches: Iterator[pa.RecordBatch], most: int | None, few: int) -> Iterator[pa.RecordBatch]:
    """One pair for each two clusters of a block that a name ties; the members of blocks above ``most`` are handed on as they come."""

    def pairs() -> Iterator[tuple]:
        for block, members in groupby(_rows(batches), key=lambda r: r[0]):
            held = list(islice(members, most + 1 if most else None))
            if most and len(held) > most:
                yield from ((r[3], None, block, r[2], r[4], r[5]) for r in chain(held, members))
            else:
                yield from ((a, b, None, None, None, None) for a, b in _ties(held, few))

    yield from batched(pairs(), _ARROW["pairs"])


@lru_cache(maxsize=50_000)
def _parts(text: str, word: int) -> list[tuple[str, str]]:
    return sorted(finer_keys(parse(text), word))


def _near_ones(members: list[tuple], few: int) -> Iterator[tuple[int, int]]:
    """Positions of members to compare: all, or in a block of more than ``few`` those that share a part by their other words."""
    if len(members) <= few:
        yield from ((i, j) for i in range(len(members)) for j in range(i))
        return
    parts: dict[str, list[tuple[int, str]]] = {}
    for i, (_, _, word, _, text, _) in enumerate(members):
        met: set[int] = set()
        for part, c in _parts(text, word):
            beside = parts.setdefault(part, [])
            met.update(j for j, k in beside if not (c and c == k))
            beside.append((i, c))
        yield from ((i, j) for j in sorted(met) if j < i)


def _ties(members: list[tuple], few: int) -> Iterator[tuple[str, str]]:
    """The first accepted pair of each two clusters of a block."""
    of = [[i] for i in range(len(members))]  # the cluster of each member, shared by its members
    for i, j in _near_ones(members, few):
        _, c, _, node, text, profile = members[i]
        _, k, _, other, known, beside = members[j]
        if of[i] is of[j] or node == other or c and c == k or not agree(profile, beside):
            continue
        if same(parse(text), parse(known), bool(profile)):
            yield node, other
            joined, own = of[j], of[i]
            joined += own
            for m in own:
                of[m] = joined


def _searched(keys: DataFrame, most: int | None) -> DataFrame:
    """Pairs found in the blocks of keys; blocks without two rows to compare, of one row or of words of one origin, never leave the JVM."""
    block = Window.partitionBy("block").orderBy("name", "node", "origin", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most_, least = F.max("origin").over(block), F.min("origin").over(block)
    met = keys.select("*", ((least < most_) | ((least == 0) & (F.count(F.lit(1)).over(block) > 1))).alias("_met")).where("_met").drop("_met")
    few = FEW
    return met.mapInArrow(lambda batches: _compared(batches, most, few), _PAIRS)


def link(entities: DataFrame, kinds: tuple[str, ...] = ("person", "organization")) -> DataFrame:
    """(id, group_id) of the entities that name one being, from columns (id, kind, name, profile).

    Names are of one being if they are spellings of each other (see ``same``) and
    their profiles agree (see ``agree``); a profile that agrees backs short words
    that differ by a slip. Names without a profile are linked to each other by
    spelling, and to the one being whose name is equal if only one is called so.
    Groups without an entity of the given kinds are left out, kinds in any letter
    case. Repeated rows count once; an id with several rows links its spellings.
    Null ids and null, empty and wordless names do not count; an empty table gives
    an empty result; other columns are ignored.

    Plan: equal (name, profile) rows collapse by a partially pre-aggregated groupBy,
    so a name held by a third of all rows is one node. Nodes are blocked by the
    phonetic codes of their words, whole and with one sound left out, beside the
    forms of the profile that another one has, in one shuffle; keys that stand alone
    are dropped before Python sees them. Each sorted block is a stream that gives at
    most one pair a joined cluster. A block above LARGE members is not compared as a
    whole, which would be quadratic, but cut by the codes of the members' other
    words in a second shuffle. Pairs are closed by connected components; names
    without profile then tie whole groups, which are closed over their labels only.
    """
    scratch = Scratch(entities.sparkSession, "names")
    known = entities.where(F.col("id").isNotNull() & F.col("name").isNotNull()).select("id", F.lower("kind").alias("kind"), "name", "profile").distinct()
    spelt = F.concat_ws("\x1f", "name_key", "profile").alias("spelt")
    nodes, all_ = scratch.save(known.mapInArrow(_parsed, NODES), n=F.count(F.lit(1)))
    each = nodes.groupBy("name_key", "profile").agg(F.min("id").alias("node"), F.min("name").alias("name"))
    each, names_ = scratch.save(each, n=F.count(F.lit(1)))
    keys = lookup(each, "profile", profile_forms(each), names_["n"] or 0).select("node", "name", "profile", "besides").mapInArrow(_blocked, _KEYS)
    found, seen = scratch.save(_searched(keys, LARGE), large=F.count("block"))
    pairs_ = found.where("b is not null").select("a", "b")
    if seen["large"]:
        large = found.where("b is null").select(F.col("a").alias("node"), "block", "word", "name", "profile")
        pairs_ = pairs_.unionByName(_searched(large.mapInArrow(_cut, _KEYS), None).select("a", "b"))
    # ids of one node, the spellings of one id, and the accepted pairs
    own = lookup(nodes.select("id", spelt), "spelt", each.select(spelt, "node"), all_["n"] or 0).select(F.col("id").alias("a"), F.col("node").alias("b"))
    groups, _ = scratch.save(components.group(own.unionByName(pairs_)))
    # a name without profile belongs to the being called exactly so, if there is one only
    being = each.join(groups.select(F.col("id").alias("node"), "group_id"), "node", "left").select("name_key", "profile", "node", F.coalesce("group_id", "node").alias("being"))
    called = being.where("profile <> ''").groupBy("name_key").agg(F.min("being").alias("low"), F.max("being").alias("high")).where("low = high")
    more, _ = scratch.save(being.where("profile = ''").join(called, "name_key").select(F.col("being").alias("a"), F.col("low").alias("b")).where("a <> b"))
    onward = components.group(more).select(F.col("id").alias("group_id"), F.col("group_id").alias("_whole"))
    lone = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"))
    closed = groups.unionByName(lone).join(onward, "group_id", "left").select("id", F.coalesce("_whole", "group_id").alias("group_id"))
    wanted = nodes.where(F.col("kind").isin(*kinds)).select("id").distinct()
    named = closed.join(wanted, "id", "left_semi").select("group_id").distinct()
    return closed.join(named, "group_id", "left_semi").select("id", "group_id")


def pairs(groups: DataFrame) -> DataFrame:
    """(a, b), a < b, for all ids of each group: the closed pairs that the result's definition asks for."""
    members = groups.groupBy("group_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    first = members.select("ids", F.posexplode("ids").alias("at", "a"))
    return first.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.greatest(F.size("ids") - F.col("at") - 1, F.lit(0)))).alias("b"))
