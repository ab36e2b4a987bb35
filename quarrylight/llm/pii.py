"""Personal details in free text: finding them, naming them by placeholders, or replacing them by surrogates.

Detection goes by type. One linear pass over a batch says which texts can hold a type at all; only
those meet its patterns. Types are taken in an order in which what is found first is not looked at
again, so that a street name is no person and an identity number no telephone number.

Given names come from a list and from the texts themselves (``learned``): a word in capitals that
stands before several of the family names that follow listed given names, and before few other
words, is a given name too. Any word in capitals that is no ordinary one is a family name after a
given name; an ending that many family names have is further evidence, never a condition.

Surrogates are keyed: the same detail (whatever its case and spacing) always becomes the same
substitute, of the same type, format, case and, for names, gender class; two different details
never share one, which is checked over all details and mended by drawing again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.llm.quality import FUNCTION_WORDS
from quarrylight.llm.vectors import plain, split_words
from quarrylight.storage import cut

TYPES = ("email", "address", "id_number", "phone", "person")

#: Endings of files that look like domains; kinds of streets; labels of numbers; endings of family names; particles.
_FILES = ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "css", "js", "json", "pdf", "zip")
_STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|drive|dr|lane|ln|close|terrace|court|ct|way|square|sq|place|pl|crescent|gardens|grove|hill|row|walk|mews|parade|circle|highway|hwy|parkway|pkwy)"
_ID_LABELS = (r"(?:passports?|reisepass|passeport|pasaporte|personalausweis|ausweis|id card|identity card|identity|carte d['’]identité|ssn|social security|soc\. sec\.|social insurance|national insurance|ni number|nino|"
              r"tax id|tax number|tax identification number|tin|steuer-?id|steuernummer|steueridentifikationsnummer|dni|nie|nif|documento|numéro fiscal|codice fiscale|personnummer|person no|national id|id number)")
_FAMILY = r"(?:vik|by|ford|ova|enko|etti|elli|sson|son|ner|str[öo]m|stroem|berry|macher|mond|ides|ander|quist|holm|gaard|ley|wright)"
_PARTICLES = r"(?:van der|van den|van|von der|von|zu|ter|de la|de los|del|della|de|du|des|di|da|la|le|al|el|bin|ben|af|av)"
#: Different family names a word must stand before to be taken for a given name, and names that may be learned.
LEAST_FAMILIES, MOST_LEARNED = 2, 200_000
#: Ordinary words with such an ending.
_NOT_FAMILY = frozenset("""container banner corner manner owner donor scanner planner partner inner dinner runner winner designer cleaner tuner person season reason lesson mason nelson prison poison comparison
nearby standby hobby ruby baby rugby lobby derby valley alley volley trolley barley medley parsley diamond almond commander wander colander lander bystander strawberry raspberry blueberry oxford afford effort
besides sides guides tides slides bridges rides provides overrides playwright copyright wright sixpenny liner opener listener beginner foreigner trainer gardener prisoner miner mariner joiner toner""".split())
_NOT_GIVEN = frozenset("""the a an this that these those my your his her its our their every each some any another one two more most all both no not even and or but if when while as at by for from in into of on to with
contact ask blame thanks handmade dear hello welcome copyright dr mr mrs ms prof mx last update code tools design from language doctype words standards chef team crew site call text see page north south east west""".split())
#: Ordinary words that stand in capitals after a given name that is a word or a brand too (The Iris Gallery), besides those above.
_THINGS = frozenset("""academy agency album app archive avenue award bank bar basin beach blog book books bridge bureau cafe café camp card castle cathedral center centre chapel church city clinic club code collection college
community company conference council county court cup dance day days design development doctype document drive edition energy estate event fair farm festival field film fire font forest form forum foundation framework gallery game garden gardens
group guide hall harbour hill home hospital hotel house inc institute island journal juice kitchen lab labs lake land language layout lane library light limited line lodge ltd magazine mall manor map market media menu mill mountain museum music network news
office oil page palette park path peak photo place plan planning plaza point pool port portal press prize problem product products project pub record region report republic resort restaurant ridge river road room sauce school sea sensor series server service services
shop site song space square stadium standards station store story street studio studios style summit sun system systems table team tech temple theater theatre theme ticket times tool tools tour tower town trade trail tree trees trust university update valley version
view village walk water way web week widget wood woods words work works world year zone january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()) | FUNCTION_WORDS | _NOT_GIVEN | _NOT_FAMILY
#: Words after which a given name is part of another name: The Iris Trail.
_BEFORE = frozenset("the a an this that these those my your his her its our their every each some any another der die das le la les el los las il lo un une una ein eine".split())

_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NUM = r"\d+[a-z]?\d*"
_TOWN = rf"{_W}"
_POST = r"(?:[a-z]{1,2}\d[a-z\d]?\s\d[a-z]{2}|\d{4,5})"

EMAIL = re.compile(r"(?<![\w.+-])[a-z0-9](?:[\w.+-]*[a-z0-9_])?(?:"
                   r"\s?@\s?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![\w-])"
                   r"|(?:\s?[\[({<]\s?(?:at|@|ä|a)\s?[\])}>]\s?|&(?:#64|#x40|commat);)[a-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?)[a-z0-9-]+)+"
                   r"|\sat\s[a-z0-9-]+(?:\sdot\s[a-z0-9-]+)+)", re.I)
ADDRESS = re.compile("(?:" + "|".join((
    # number, street, unit, town, postcode
    rf"(?<![\w.,-]){_NUM}\s(?:(?:[nsew]|north|south|east|west)\b\.?\s)?(?!(?:of|on|in|at|the|to|and)\s){_W}(?:\s{_W})?\s{_STREET}\b\.?,\s(?:(?:suite|flat|apt|apartment|unit|floor|room)\.?\s\w+,?\s)?{_TOWN}(?:,\s[a-z]{{2}}(?=\s\d))?(?:,?\s{_POST}\b)?",
    rf"(?<![\w.-]){_NUM},\s(?:rue|avenue|quai|chemin|boulevard|place|impasse|allée|cours|route)\s(?:(?:de\sla|de\sl['’]|du|des|de)\s?)?{_W}(?:\s{_W})?,\s\d{{5}}\s{_TOWN}",
    rf"\b(?:calle|avenida|plaza|paseo|camino|ronda|travesía|c/)\s(?:de\s(?:la\s|los\s)?)?{_W}(?:\s{_W})?,?\s{_NUM}(?:,\s\d+\s?[º°ª](?:\s[a-z])?)?,\s\d{{5}}\s{_TOWN}",
    rf"\b{_W}\s?(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\s{_NUM},\s\d{{5}}\s{_TOWN}",
    rf"\bvia\s{_W}(?:\s{_W})?,?\s{_NUM},\s\d{{5}}\s{_TOWN}",
)) + ")", re.I)
ID_NUMBER = re.compile(rf"(?<!\w){_ID_LABELS}(?:\s(?:no|nr|nº|number|num|card|id))?\b\.?\s?[:=#]?\s?"
                       r"((?:[a-z]{2}\s\d\d\s\d\d\s\d\d\s[a-d]|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{3}-\d{2}-\d{4}|\d{6,8}-\d{4}|\d{8}[a-z]|[a-z]{1,3}\d[a-z\d]{5,12}|\d[a-z\d]{7,14}|\d{3}\s\d{3}\s\d{3}))(?![\w-])", re.I)
PHONE = re.compile(r"(?<![\w.+/-])(?:"
                   r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,6}){2,6}"
                   r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]\d{3,5}"
                   r"|1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}|\d{3}([-.])\d{3}\1\d{4}"
                   r"|0[1-9](?:\.\d\d){4}|0[1-9]\d{0,4}(?:(?:[ ]\d{2,4}){2,5}|[/-]\d{3,}(?:[ -]\d{2,5})?|[ ]\d{5,8})"
                   r")(?![\w/]|[-.]\d)")
_FAM = rf"[^\W\d_]{{2,}}{_FAMILY}\b(?:-[^\W\d_]+)?"
_INITIALS = r"(?:[ \n][^\W\d_]\.)*"
REVERSED = re.compile(rf"(?<![\w@.'-])((?:{_PARTICLES}[ \n])?{_FAM}),[ \n]([^\W\d_]{{2,}}{_INITIALS})(?![\w@]|\.\w)", re.I)
PERSON = re.compile(rf"(?<![\w@.'-])([^\W\d_]{{2,}}){_INITIALS}((?:[ \n]{_PARTICLES})?)[ \n]({_FAM})(?![\w@]|\.\w)", re.I)

_GIVEN = re.compile(r"(?<![\w@.'-])[^\W\d_]{2,}(?:-[^\W\d_]+)?")
_AFTER = re.compile(rf"{_INITIALS}(?:[ \n]{_PARTICLES})?[ \n]((?:[^\W\d_]['’])?[^\W\d_]{{2,}}(?:['’](?!s\b)[^\W\d_]+|-[^\W\d_]+)*)(?![\w@]|\.\w)", re.I)
_LISTED_LAST = re.compile(r"(?:^|(?<=: ))((?:[^\W\d_]['’])?[^\W\d_]{2,}(?:['’-][^\W\d_]+)*),[ \n]([^\W\d_]{2,})" + _INITIALS + r"(?=[ \t]*$)", re.M)

#: What a text must have for a type: patterns without counted repeats over the lower-cased text with
#: single blanks (RE2 runs each as one automaton, in one pass).
NEAR = {
    "email": r"@|[\[({<] ?(?:at|ä|a) ?[\])}>]|&(?:#64|#x40|commat);| at [a-z0-9-]+ dot ",
    "address": rf" {_STREET}\.?, |, (?:rue|avenue|quai|chemin|boulevard|place|impasse|allée|cours|route) |\b(?:calle|avenida|plaza|paseo|camino|ronda|travesía|c/|via) |(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer) \d",
    "id_number": _ID_LABELS,
    "phone": r"\+\d|\(\d\d+\)|1[-. ]\d\d\d[-. ]\d|\d\d\d[-.]\d\d\d[-.]\d\d\d\d|\b0\d+[ ./-]\d",
}
#: A person: two words in title case, the second with the ending of a family name (over the text as it is), or a listed given name.
_TITLED = rf"\p{{Lu}}\p{{Ll}}+(?: \p{{L}}\.)*(?: [a-z]+)*[ -]\p{{Lu}}\p{{Ll}}+{_FAMILY}\b|{_FAMILY},[ ]\p{{Lu}}"


def _family(word: str) -> bool:
    return all(p.lower() not in _NOT_FAMILY for p in word.split("-"))


def _persons(text: str, names: frozenset[str]) -> Iterator[tuple[int, int]]:
    taken: list[tuple[int, int]] = []
    for m in REVERSED.finditer(text):
        family, given = m.group(1), m.group(2).split()[0]
        known = given.lower() in names
        title = given[:1].isupper() and family[:1].isupper()
        if _family(family.split()[-1]) and (known or (title and not given.isupper() and given.lower() not in _NOT_GIVEN and len(given) > 2 and not _label_follows(text, m.end()))):
            end = m.end()
            taken.append((m.start(), end))
            yield m.start(), end
    at = 0
    while m := PERSON.search(text, at):
        at = m.start() + len(m.group(1))  # the given name may be the next word
        if any(a < m.end() and m.start() < b for a, b in taken):
            continue
        given, family = m.group(1), m.group(3)
        known = given.lower() in names
        title = given[:1].isupper() and not given.isupper() and family[:1].isupper() and not family.isupper() and given.lower() not in _NOT_GIVEN and len(given) > 2
        if _family(family) and (known or title or _capital_line(text, m.start(), m.end())):
            taken.append((m.start(), m.end()))
            yield m.start(), m.end()
            at = m.end()
    for a, b in _listed(text, names):
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            yield a, b


def _listed(text: str, names: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Listed given names with any family name in capitals that is no ordinary word, whatever its ending."""
    for m in _LISTED_LAST.finditer(text):
        if m.group(2).lower() in names and m.group(1).lower() not in names and _any_family(text, m.group(1), m.group(2), m.end()):
            yield m.start(), m.end()
    for g in _GIVEN.finditer(text):
        if not g.group(0)[0].isupper() or g.group(0).split("-")[0].lower() not in names:
            continue
        before = re.search(r"([^\W\d_]+)\s$", text[max(0, g.start() - 20):g.start()])
        if before and before.group(1).lower() in _BEFORE:
            continue
        if not (m := _AFTER.match(text, g.end())):
            continue
        if m.group(1).lower() in names and (more := _AFTER.match(text, m.end())) and _any_family(text, more.group(1), g.group(0), more.end()):
            m = more  # a second given name
        if _any_family(text, m.group(1), g.group(0), m.end()):
            shouted = before and len(before.group(1)) > 1 and before.group(1).isupper() or re.match(r"\s[^\W\d_]*[A-Z]{2}", text[m.end():])
            if not (m.group(1).isupper() and shouted):
                yield g.start(), m.end()


def _any_family(text: str, family: str, given: str, end: int) -> bool:
    return family[0].isupper() and family.isupper() == given.isupper() and not _label_follows(text, end) and all(w.lower() not in _THINGS for w in re.split("['’-]", family))


def _capital_line(text: str, begin: int, end: int) -> bool:
    """Whether a name in capitals is all that stands after a label on its line."""
    return text[begin:end].isupper() and text[max(0, begin - 2):begin] == ": " and text[end:end + 1] in ("", "\n")


def _label_follows(text: str, end: int) -> bool:
    return text[end:end + 1] == ":"


def find(text: str, names: frozenset[str], types: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the personal details of a text, in order, none overlapping."""
    out: list[tuple[int, int, str]] = []

    def add(begin: int, end: int, kind: str) -> None:
        if not any(a < end and begin < b for a, b, _ in out):
            out.append((begin, end, kind))

    wanted = types if types is not None else set(TYPES)
    if "email" in wanted:
        for m in EMAIL.finditer(text):
            if re.split(r"[.\s\])}>]", m.group(0))[-1].lower() not in _FILES:
                add(m.start(), m.end(), "email")
    if "address" in wanted:
        for m in ADDRESS.finditer(text):
            add(m.start(), m.end(), "address")
    if "id_number" in wanted:
        for m in ID_NUMBER.finditer(text):
            add(m.start(1), m.end(1), "id_number")
    if "phone" in wanted:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group(0)) <= 15:
                add(m.start(), m.end(), "phone")
    if "person" in wanted:
        for a, b in _persons(text, names):
            add(a, b, "person")
    return sorted(out)


def _types_of(texts: pa.Array, names: frozenset[str]) -> list[set[str]]:
    flat = pc.replace_substring_regex(texts, r"\s+", " ")
    low = pc.utf8_lower(flat)
    hits = {k: pc.match_substring_regex(low, p).to_numpy(zero_copy_only=False) for k, p in NEAR.items()}
    hits["person"] = pc.match_substring_regex(flat, _TITLED).to_numpy(zero_copy_only=False) | _with_name(texts, names)
    out: list[set[str]] = [set() for _ in range(len(texts))]
    for kind, hit in hits.items():
        for k in np.flatnonzero(hit).tolist():
            out[k].add(kind)
    return out


def _with_name(texts: pa.Array, names: frozenset[str]) -> np.ndarray:
    """Which texts have a given name among their words: each distinct word of the batch is looked up once."""
    words, offsets = split_words(texts)
    if not len(words):
        return np.zeros(len(texts), bool)
    coded = words.dictionary_encode()
    known = np.array([w in names for w in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = np.zeros(len(texts), bool)
    out[owner[known]] = True
    return out


def _spans(texts: pa.Array, names: frozenset[str]) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    likely = _types_of(texts, names)
    rows = [k for k, t in enumerate(likely) if t]
    for k, text in zip(rows, texts.take(pa.array(rows, pa.int64())).to_pylist()):
        if spans := find(text, names, likely[k]):
            yield k, text, spans


@lru_cache(maxsize=4)
def _frozen(names: tuple[str, ...]) -> frozenset[str]:
    return frozenset(names)


_CAPITALS = re.compile(rf"(?<![\w@.'-])(?=([^\W\d_]{{2,}}){_INITIALS}(?:[ \n]{_PARTICLES})?[ \n]([^\W\d_]{{2,}}(?:-[^\W\d_]+)*)(?![\w@]|\.\w))")


def learned(df: DataFrame, listed: tuple[str, ...], text: str = "text") -> tuple[str, ...]:
    """Given names the texts show beside the ``listed`` ones, in lower case.

    Pairs of neighbouring words in title case (initials and particles between them) are made
    distinct over all texts. The second word of a pair whose first is listed is a family name. A
    first word that is no ordinary word, stands before LEAST_FAMILIES of them or more, and before
    as many of them as of other words, is a given name. More than MOST_LEARNED are an error.
    """
    known = frozenset(listed)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column(0))
            near = pc.match_substring_regex(texts, r"\p{Lu}\p{Ll}+(?:\s\p{L}\.)*(?:\s\p{Ll}{1,3}){0,2}\s\p{Lu}\p{Ll}")
            found = set()
            for t in texts.filter(near).to_pylist():
                for m in _CAPITALS.finditer(t):
                    g, f = m.group(1), m.group(2)
                    if g[0].isupper() and f[0].isupper() and g[1:].islower():
                        found.add((g.lower(), f.lower()))
            # a family name is no ordinary word and no given name; such followers speak against the first word
            rows = sorted((g, f, g in known) for g, f in found if g not in known or (f not in _THINGS and f not in known))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["g", "f", "listed"])

    every = cut(df.where(F.col(text).isNotNull()).select(F.col(text).cast("string")).mapInArrow(pairs, "g string, f string, listed boolean").distinct(), "name-pairs")
    family = every.where("listed").select("f").distinct().withColumn("known", F.lit(1))
    told = every.where("NOT listed").join(family, "f", "left").groupBy("g").agg(F.count("known").alias("families"), F.count(F.lit(1)).alias("pairs"))
    rows = told.where((F.col("families") >= LEAST_FAMILIES) & (F.col("families") * 2 >= F.col("pairs"))).select("g").limit(MOST_LEARNED + 1).collect()
    if len(rows) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED:,} words look like given names")
    return tuple(sorted(r.g for r in rows if r.g not in _THINGS))


def known_names(names: DataFrame | None) -> tuple[str, ...]:
    """The list of given names, lower case; at most 200,000 are taken to the tasks (more is an error)."""
    if names is None:
        return ()
    rows = names.select(F.lower(F.trim(names.columns[0]))).where(F.col(names.columns[0]).isNotNull()).distinct().limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("a list of given names has at most 200,000 entries")
    return tuple(sorted(r[0] for r in rows if r[0]))


def all_names(df: DataFrame, names: DataFrame | None, text: str) -> tuple[str, ...]:
    """Listed and learned given names."""
    listed = known_names(names)
    return tuple(sorted({*listed, *learned(df, listed, text)}))


def details(df: DataFrame, names: DataFrame | None = None, number: str = "find_id", text: str = "text") -> DataFrame:
    """(number, pii_type, found): the distinct personal details of each text, as they stand there.

    NULL and empty texts have none; texts are read whole, where they lie; other columns are not read.
    """
    return _details(df, all_names(df, names, text), number, text)


def _details(df: DataFrame, listed: tuple[str, ...], number: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _frozen(listed)
        for b in batches:
            rows, kinds, found = [], [], []
            for k, t, spans in _spans(plain(b.column(1)), known):
                for kind, what in dict.fromkeys((kind, t[i:j]) for i, j, kind in spans):
                    rows.append(k)
                    kinds.append(kind)
                    found.append(what)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=[number, "pii_type", "found"])

    kind = df.schema[number].dataType.simpleString()
    return df.where(F.col(text).isNotNull()).select(number, F.col(text).cast("string")).mapInArrow(run, f"`{number}` {kind}, pii_type string, found string")


def redacted(df: DataFrame, names: DataFrame | None = None, number: str = "find_id", text: str = "text") -> DataFrame:
    """(number, text, details): each text with its details replaced by ``[EMAIL]``, ``[PHONE]`` and so on, and their number.

    Every row comes out; a NULL text stays NULL.
    """
    listed = all_names(df, names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _frozen(listed)
        for b in batches:
            texts, counts = b.column(1).to_pylist(), [0] * b.num_rows
            for k, t, spans in _spans(plain(b.column(1)), known):
                for i, j, kind in reversed(spans):
                    t = f"{t[:i]}[{kind.upper()}]{t[j:]}"
                texts[k], counts[k] = t, len(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[number, "text", "details"])

    kind = df.schema[number].dataType.simpleString()
    return df.select(number, F.col(text).cast("string")).mapInArrow(run, f"`{number}` {kind}, text string, details int")


# --- surrogates ---------------------------------------------------------------------------------
_SOUNDS = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "po", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "vo", "za")


def norm(kind: str, found: str) -> str:
    """What all spellings of one detail have in common."""
    x = " ".join(found.split()).casefold()
    if kind == "phone":
        return re.sub(r"\D", "", x)
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", x)
    if kind == "email":
        x = re.sub(r"\s?[\[({<]\s?(?:at|@|ä|a)\s?[\])}>]\s?|&(?:#64|#x40|commat);|\s?@\s?|\sat\s", "@", x, count=1)
        return re.sub(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s", ".", x)
    if kind == "person" and "," in x:
        family, _, given = x.partition(", ")
        return f"{given} {family}"
    return x


_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|ä|a)\s?[\])}>]\s?|&(?:#64|#x40|commat);|\s?@\s?|\sat\s", re.I)
_DOT = re.compile(r"(\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)", re.I)
_PARTICLE = frozenset(re.findall(r"\w+", _PARTICLES[3:-1]))
_KEPT = re.compile(rf"{_STREET}|{_PARTICLES}|suite|flat|apt|apartment|unit|floor|room|rue|avenue|quai|chemin|calle|avenida|plaza|[a-z]{{1,2}}", re.I)
#: The letters of the syllables in other scripts.
_SCRIPTS = (("\u0370", "\u03ff", str.maketrans("abdefgklmnoprstvz", "αβδεφγκλμνοπρστβζ")), ("\u0400", "\u04ff", str.maketrans("abdefgklmnoprstvz", "абдефгклмнопрствз")))


def surrogate(kind: str, found: str, key: bytes, names: tuple[str, ...], attempt: int = 0) -> str:
    """A substitute for ``found``: keyed by the detail, alike in type, format, case, script and gender class.

    Spellings of one detail get spellings of one substitute: what is drawn depends on ``norm`` only,
    and is put in the places of the letters and digits of ``found``.
    """
    what = norm(kind, found)

    def source(part: str):
        return iter(hmac.new(key, f"{kind}\0{what}\0{attempt}\0{part}".encode(), hashlib.sha512).digest() * 8)

    draw = source("")
    word = lambda n, d=draw: "".join(_SOUNDS[next(d) % len(_SOUNDS)] for _ in range(n))
    if kind in ("phone", "id_number"):  # digits for digits, letters for letters; the punctuation stays
        return "".join(str(next(draw) % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + next(draw) % 26) if c.isalpha() else c for c in found)
    if kind == "email":  # the at and the dots as they are written
        at = _AT.search(found)
        parts = _DOT.split(found[at.end():])
        parts[::2] = [*(word(2) for _ in parts[2::2]), "example"]
        local = f"{word(3)}{next(draw) % 100}"
        return _cased(local, found, True) + at.group(0) + "".join(p if k % 2 else _cased(p, found, True) for k, p in enumerate(parts))
    if kind == "address":
        return re.sub(_W + r"|\d", lambda m: str(next(draw) % 10) if m.group(0).isdigit() else m.group(0) if _KEPT.fullmatch(m.group(0)) else _cased(_scripted(word(3), m.group(0)), m.group(0)), found)
    # a name: the given one from the list, the family's words, the letters of initials; particles stay
    comma = found.find(",")
    words = list(re.finditer(r"[^\W\d_]+", found))
    given_at = next((m.start() for m in words if m.start() > comma), 0)
    feminine = next((m.group(0) for m in words if m.start() == given_at), "").lower().endswith(("a", "e", "is"))
    family, initials = source("family"), source("initials")
    pool = [n for n in names if n.endswith(("a", "e", "is")) == feminine] or [word(2)]
    given = pool[(next(draw) * 65536 + next(draw) * 256 + next(draw)) % len(pool)]

    def made(m: re.Match) -> str:
        x, after = m.group(0), found[m.end():m.end() + 1]
        if m.start() == given_at:
            return _cased(given if _scripted("a", x) == "a" else _scripted(word(2), x), x)
        if len(x) == 1 and after == ".":
            return _cased(_scripted("abdefgklmnoprstvz"[next(initials) % 17], x), x, not x.isupper())
        if x.lower() in _PARTICLE or len(x) == 1:
            return x
        return _cased(_scripted(word(3, family), x), x)

    return re.sub(r"[^\W\d_]+", made, found)


def _scripted(made: str, like: str) -> str:
    """``made`` in the script of ``like``: Greek, Cyrillic, else Latin."""
    for low, high, letters in _SCRIPTS:
        if low <= like[0] <= high:
            return made.translate(letters)
    return made


def _cased(made: str, like: str, whole: bool = False) -> str:
    if like.isupper():
        return made.upper()
    return made if whole or like.islower() else made.capitalize()


def surrogates(df: DataFrame, key: bytes, names: DataFrame | None = None, number: str = "find_id", text: str = "text", rounds: int = 16) -> DataFrame:
    """(pii_type, entity, surrogate): see ``_drawn``."""
    return _drawn(df, key, all_names(df, names, text), number, text, rounds).select("pii_type", "entity", "surrogate")


def _drawn(df: DataFrame, key: bytes, listed: tuple[str, ...], number: str, text: str, rounds: int = 16) -> DataFrame:
    """(pii_type, entity, surrogate, attempt): every different detail of the table with its own substitute.

    A substitute that two details would share, or that is itself a detail of the table, is drawn
    again for all but one of them, until none is left (``rounds`` at most; more is an error).
    """
    @F.pandas_udf("string")
    def drawn(kind, what, attempt):
        return kind.combine(what, lambda k, w: (k, w)).combine(attempt, lambda kw, n: surrogate(kw[0], kw[1], key, listed, int(n)))

    every = _details(df, listed, number, text).select("pii_type", _entity()("pii_type", "found").alias("entity")).distinct()
    rows = cut(every.withColumn("attempt", F.lit(0)), "surrogates").withColumn("surrogate", drawn("pii_type", "entity", "attempt"))
    for _ in range(rounds):
        rows = cut(rows, "surrogates")
        again = F.row_number().over(Window.partitionBy("pii_type", "surrogate").orderBy("attempt", "entity")) > 1
        real = rows.select("pii_type", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = cut(rows.withColumn("again", again).join(real, ["pii_type", "surrogate"], "left").withColumn("again", F.col("again") | F.coalesce("real", F.lit(False))).drop("real"), "surrogates")
        if not judged.where("again").limit(1).count():
            return judged.select("pii_type", "entity", "surrogate", "attempt")
        fresh = judged.where("again").withColumn("attempt", F.col("attempt") + 1)
        rows = judged.where("NOT again").drop("again").unionByName(fresh.withColumn("surrogate", drawn("pii_type", "entity", "attempt")).drop("again"))
    raise RuntimeError("surrogates still collide: the key space of a type is too small")


def _entity():
    @F.pandas_udf("string")
    def entity(kind, found):
        return found.combine(kind, lambda f, k: norm(k, f))

    return entity


def replaced(df: DataFrame, key: bytes, names: DataFrame | None = None, number: str = "find_id", text: str = "text") -> DataFrame:
    """(number, text, details): each text with its details replaced by their surrogates, each in the spelling found, and their number.

    Every row comes out; a NULL text stays NULL. Only the few details drawn again because of a
    collision are joined with the texts; all others follow from the key alone.
    """
    listed = all_names(df, names, text)
    again = _drawn(df, key, listed, number, text).where("attempt > 0").select("pii_type", "entity", "attempt")
    own = _details(df, listed, number, text).withColumn("entity", _entity()("pii_type", "found")).join(again, ["pii_type", "entity"])
    own = own.groupBy(F.col(number).alias("_n")).agg(F.collect_list(F.struct("pii_type", "entity", "attempt")).alias("_again"))
    rows = df.select(number, F.col(text).cast("string")).join(own, F.col(number).eqNullSafe(F.col("_n")), "left").drop("_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _frozen(listed)
        for b in batches:
            texts, counts = b.column(1).to_pylist(), [0] * b.num_rows
            for k, t, spans in _spans(plain(b.column(1)), known):
                attempts = {(x["pii_type"], x["entity"]): x["attempt"] for x in b.column(2)[k].as_py() or ()}
                for i, j, kind in reversed(spans):
                    t = t[:i] + surrogate(kind, t[i:j], key, listed, attempts.get((kind, norm(kind, t[i:j])), 0)) + t[j:]
                texts[k], counts[k] = t, len(spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[number, "text", "details"])

    kind = df.schema[number].dataType.simpleString()
    return rows.mapInArrow(run, f"`{number}` {kind}, text string, details int")
