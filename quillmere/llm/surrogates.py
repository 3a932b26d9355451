"""PII: surrogate generation. Detected entities get keyed replacements of the same type and format.

**Detection.**  Emails, IPv4 addresses, phone and card numbers, social security numbers, IBANs, secrets (named tokens, long hex), and
persons behind an honorific or words that tell a name ("my name is", "Name:", "Dear"), in Latin, Cyrillic or Greek script.  What a document calls a person by so is
replaced wherever else it stands in that document: the full name, and each of its words alone.  A name that nothing of that kind tells anywhere in its document isn't detected.

**Surrogates.**  What has a fixed form is mapped by a keyed permutation of all strings of the same form (a Feistel network over mixed
radixes with cycle walking): digits stay digits, letters stay letters of their case and script, punctuation stays, a card number (a number
of 13 to 19 digits that passes the Luhn check) gets one that passes, an IBAN keeps its country and gets valid check digits.  Names are built from syllables by script.  A
given name has one gender in the whole corpus, that of the honorifics it has been seen with, or none if there is none or they differ; its surrogate's ending is of
that gender.  So "Mrs", "Dr" and no honorific before one name give one surrogate.  The same entity gets the same surrogate in every document and every way of
writing it (case of emails, separators of numbers, given name left out), so coreference stays.

**Collisions.**  Over the whole corpus, distinct entities of a type must get distinct surrogates, and no surrogate may be an entity of that type that
really occurs; given and family names are one type here.  Permutations can't break the first, names and the second can: conflicts are found by aggregation over the table of
distinct entities and drawn again with the next attempt until none is left.  Entities with an attempt other than 0, and given names with a gender, are the exceptions; they are
broadcast while they are fewer than a bound, and otherwise joined by document.

Defined results: a null text stays null and an empty one empty; a null id stays null; overlapping matches: the one that begins first, then the
longer, wins; repeated rows get equal results; ties don't arise as surrogates are functions of key, type and value; other columns
aren't looked at.  The key is a parameter: whoever has it could recompute surrogates, so production passes its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

KEY = b"replace this key in production"
MALE, FEMALE, EITHER = "m", "f", "u"
HONORIFICS = {
    MALE: ["Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "господин", "Κύριος", "κύριος"],
    FEMALE: ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mme", "Mlle", "Госпожа", "госпожа", "Κυρία", "κυρία"],
    EITHER: ["Dr", "Prof"],
}
GENDER = {h: g for g, hs in HONORIFICS.items() for h in hs}
_TITLES = "|".join(sorted(GENDER, key=len, reverse=True))
_UP = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ"
_NAME = rf"[{_UP}][^\W\d_]+(?:[-'][{_UP}][^\W\d_]+)?"
_CUES = r"(?:(?i:my name is|mein name ist|ich heiße|je m'appelle|mon nom est|me llamo|mi nombre es)|(?:Name|Nom|Nombre|Contact|Kontakt|Contacto)[ ]?:|(?:Dear|Lieber?|Cher|Chère|Querid[oa]))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = re.compile(
    "|".join(
        [
            r"(?P<email>[^\W_](?:[\w.+%-]*\w)?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+)",
            rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d))",
            r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))",
            r"(?P<secret>(?<!\w)(?:(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_-]{12,}={0,2})|(?<!\w)(?P<hex>[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w))",
            r"(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            rf"(?P<person>(?<!\w)(?P<title>{_TITLES})\.?[ ]{{1,2}}(?P<name>{_NAME}(?: {_NAME}){{0,2}})|(?<!\w){_CUES}[ ]{{1,2}}(?P<cued>{_NAME}(?: {_NAME}){{1,2}}))",
        ]
    )
)
#: Texts without a match of this (linear, RE2) can't hold an entity.
_MAYBE = rf"[@0-9]|(?i:token|secret|passw|key)\s*[=:]|(?:{_TITLES})\.?  ?[{_UP}]|{_CUES}  ?[{_UP}]"


class Feistel:
    """A keyed permutation of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def digest(self, *parts: object) -> int:
        data = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "little")

    def permute(self, x: int, bound: int, *tweak: object) -> int:
        """x -> its image among 0..bound-1."""
        half = max(1, (max(bound - 1, 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        words = -(-half // 256)
        while True:
            a, b = x >> half, x & mask
            for r in range(6):
                f = 0
                for w in range(words):
                    f = f << 256 | self.digest(*tweak, bound, r, w, b)
                a, b = b, a ^ (f & mask)
            x = a << half | b
            if x < bound:
                return x


_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _ACCENTED, _CYRILLIC, _GREEK]
CLASS_OF = {c: k for k in CLASSES for c in k}


def form_preserving(text: str, f: Feistel, *tweak: object, classes: dict[str, str] = CLASS_OF) -> str:
    """The image of a string among all strings of its form: every character keeps its class, those of no class stay."""
    kinds = [classes.get(c) for c in text]
    bound, value = 1, 0
    for c, k in zip(text, kinds, strict=True):
        if k:
            bound *= len(k)
            value = value * len(k) + k.index(c)
    if bound == 1:
        return text
    form = "".join(k[0] if k else c for c, k in zip(text, kinds, strict=True))
    value = f.permute(value, bound, *tweak, form)
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            value, i = divmod(value, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_HEX_UP = {c: "0123456789ABCDEF" for c in "0123456789ABCDEF"}
SYLLABLES = {
    "latin": ["ba", "be", "bo", "ca", "co", "da", "de", "do", "el", "fa", "fe", "ga", "go", "ha", "he", "ja", "jo", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "wi", "za", "ze"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "жа", "за", "зо", "ка", "ко", "ла", "ле", "ма", "ме", "на", "не", "па", "пе", "ра", "ре", "са", "со", "та", "то", "фе", "ша", "ю"],
    "greek": ["βα", "γε", "γα", "δη", "δα", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "με", "να", "νε", "πα", "πε", "ρα", "ρο", "σα", "σο", "τα", "τε", "φα", "χα", "ψα"],
}
ENDINGS = {
    ("latin", "given", MALE): ["n", "rd", "s", "ric", "l"],
    ("latin", "given", FEMALE): ["na", "lia", "tta", "ssa", "line"],
    ("latin", "given", EITHER): ["ri", "x", "y"],
    ("latin", "family", EITHER): ["ler", "mann", "ton", "rez", "sen", "ville"],
    ("cyrillic", "given", MALE): ["слав", "мир", "н"],
    ("cyrillic", "given", FEMALE): ["на", "лия", "ра"],
    ("cyrillic", "given", EITHER): ["ша", "ня"],
    ("cyrillic", "family", EITHER): ["енко", "ич", "ук"],
    ("greek", "given", MALE): ["ος", "ης", "ων"],
    ("greek", "given", FEMALE): ["ία", "ηνη", "ώ"],
    ("greek", "given", EITHER): ["ις"],
    ("greek", "family", EITHER): ["πουλος", "ίδης", "άκης"],
}


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def surrogate(f: Feistel, kind: str, value: str, attempt: int, gender: str = EITHER) -> str:
    """The replacement of a normalised entity; the gender is that of a given name."""
    if kind in ("phone", "ssn"):
        return form_preserving(value, f, kind, attempt)
    if kind == "card":
        x = form_preserving(value, f, kind, attempt)
        while not luhn(x):  # along the cycle of the permutation: it ends at a valid number, at the latest at the first
            x = form_preserving(x, f, kind, attempt)
        return x
    if kind == "ip":
        n = 0
        for part in value.split("."):
            n = n << 8 | int(part)
        n = f.permute(n, 1 << 32, kind, attempt)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "email":
        local, _, domain = value.partition("@")
        rest, _, tld = domain.rpartition(".")
        return f"{form_preserving(local, f, 'local', attempt)}@{form_preserving(rest, f, 'domain', attempt)}.{tld}"
    if kind == "iban":
        body = value[:2] + "00" + form_preserving(value[4:], f, kind, value[:2], attempt)
        if mod97(value) == 1:
            return body[:2] + f"{98 - mod97(body):02d}" + body[4:]
        return body[:2] + form_preserving(value[2:4], f, kind, "check", value[4:], attempt) + body[4:]
    if kind == "secret":
        low, up = all(c in _HEX for c in value), all(c in _HEX_UP for c in value)
        return form_preserving(value, f, kind, attempt, classes=_HEX if low else _HEX_UP if up else CLASS_OF)
    # given:<script> and family:<script>
    part, script = kind.split(":")
    d = f.digest(kind, value, attempt)
    syllables, endings = SYLLABLES[script], ENDINGS[script, part, gender if part == "given" else EITHER]
    out = []
    for _ in range(2 if part == "given" else 3):
        d, i = divmod(d, len(syllables))
        out.append(syllables[i])
    for _ in range(attempt // 2):  # the space grows with the attempts
        d, i = divmod(d, len(syllables))
        out.append(syllables[i])
    return "".join(out) + endings[d % len(endings)]


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it, c) if c.isascii() and c.isdigit() else c for c in shape)


def _cased(like: str, word: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def entity(m: re.Match) -> tuple | None:
    """(start, end, [(kind, value)], rebuild) of a match, or None; ``rebuild`` makes the replacement from the surrogates of the values."""
    kind = next(name for name in ("email", "ip", "iban", "ssn", "phone", "secret", "card", "person") if m.group(name) is not None)
    whole = m.group(kind)
    if kind == "email":
        shape = whole
        return m.start(), m.end(), [(kind, whole.lower())], lambda s, shape=shape: "".join(c.upper() if o.isupper() else c for o, c in zip(shape, s[0], strict=True)) if len(shape) == len(s[0]) else s[0]
    elif kind == "ip":
        return m.start(), m.end(), [(kind, whole)], lambda s: s[0]
    elif kind == "iban":
        return m.start(), m.end(), [(kind, whole.replace(" ", ""))], lambda s, w=whole: _spread(w, s[0])
    elif kind == "card" and not luhn(_digits(whole)):
        return None  # a long number like any other
    elif kind in ("ssn", "card"):
        return m.start(), m.end(), [(kind, _digits(whole))], lambda s, w=whole: _fill(w, s[0])
    elif kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", whole)
        at = code.end() if code else 0
        return m.start() + at, m.end(), [(kind, _digits(whole[at:]))], lambda s, w=whole[at:]: _fill(w, s[0])
    elif kind == "secret":
        name = "value" if m.group("value") is not None else "hex"
        return m.start(name), m.end(name), [(kind, m.group(name))], lambda s: s[0]
    else:
        name = "name" if m.group("name") is not None else "cued"
        words = m.group(name).split(" ")
        return m.start(name), m.end(name), [(k, w.lower()) for k, w in zip(name_kinds(words), words, strict=True)], lambda s, ws=words: " ".join(_cased(w, x) for w, x in zip(ws, s, strict=True))


def name_kinds(words: list[str]) -> list[str]:
    return [f"given:{script_of(w)}" for w in words[:-1]] + [f"family:{script_of(words[-1])}"]


def scan(text: str) -> tuple[list[tuple], list[tuple[str, str, str]]]:
    """([(start, end, [(kind, value)], rebuild)] of all entities in order, [(kind, value, gender)] of the given names behind an honorific).

    Every word of a name that the text tells is an entity of one kind in its document, wherever it stands; a word that is given and family name is a family name.
    """
    found, names, genders = [], {}, []
    kinds: dict[str, str] = {}
    for m in PATTERN.finditer(text):
        one = entity(m)
        if one is None:
            continue
        found.append(one)
        name = m.group("name") or m.group("cued")
        if name is not None:
            words = names[len(found) - 1] = name.split(" ")
            for k, w in zip(name_kinds(words), words, strict=True):
                if k.startswith("family") or w not in kinds:
                    kinds[w] = k
    if not names:
        return found, genders
    for i, words in names.items():
        found[i] = (*found[i][:2], [(kinds[w], w.lower()) for w in words], found[i][3])
    for m in PATTERN.finditer(text):
        if m.group("title"):
            genders += [(kinds[w], w.lower(), GENDER[m.group("title")]) for w in m.group("name").split(" ")[:-1] if kinds[w].startswith("given")]
    any_name = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(kinds, key=lambda w: (-len(w), w)))) + r")(?!\w)")
    known, at, more = len(found), 0, []
    for m in any_name.finditer(text):
        while at < known and found[at][1] <= m.start():
            at += 1
        if at == known or m.end() <= found[at][0]:
            w = m.group()
            more.append((m.start(), m.end(), [(kinds[w], w.lower())], lambda s, w=w: _cased(w, s[0])))
    return sorted(found + more, key=lambda x: x[0]), genders


def _spread(shape: str, text: str) -> str:
    it = iter(text)
    return "".join(" " if c == " " else next(it) for c in shape)


def rewrite(text: str, f: Feistel, odd: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, int]:
    """(text with surrogates, entities replaced). ``odd``: attempt and gender of the exceptions."""
    out, at, n = [], 0, 0
    for start, end, values, rebuild in scan(text)[0]:
        out += [text[at:start], rebuild([surrogate(f, k, v, *odd.get((k, v), (0, EITHER))) for k, v in values])]
        at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def _maybe(column: pa.Array) -> list[int]:
    """Rows that may hold an entity."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _MAYBE), False).to_numpy(zero_copy_only=False)).tolist()


def _found(text: str) -> set[tuple[str, str, str]]:
    """(kind, value, gender) of all entities of a text; the gender is none for most."""
    found, genders = scan(text)
    return {(k, v, EITHER) for _, _, values, _ in found for k, v in values} | set(genders)


def _mentions(with_key: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = sorted({(i if with_key else 0, *x) for i in _maybe(texts) for x in _found(texts[i].as_py())})
            cols = [pa.array([x[j] for x in rows], pa.string()) for j in (1, 2, 3)]
            names = ["kind", "value", "gender"]
            if with_key:
                at = pa.array([i for i, *_ in rows], pa.int64())
                cols, names = [batch.column(0).take(at), batch.column(1).take(at), *cols], ["k", "v", *names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _draw(key: bytes):
    def run(batches):
        f = Feistel(key)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            drawn = pa.array([surrogate(f, k, v, a, g) for k, v, g, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], drawn], names=["kind", "value", "gender", "attempt", "s"])

    return run


def exceptions(rows: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """(kind, value, gender, attempt) of the entities whose first surrogate collides, and of given names with a gender. ``rows``: column t."""
    told = rows.select("t").mapInArrow(C.lean(_mentions(False)), "kind string, value string, gender string")
    seen = lambda g: F.max((F.col("gender") == g).cast("int"))
    one = F.when(F.col("m") > F.col("f"), MALE).when(F.col("f") > F.col("m"), FEMALE).otherwise(EITHER)
    found = told.groupBy("kind", "value").agg(seen(MALE).alias("m"), seen(FEMALE).alias("f")).select("kind", "value", one.alias("gender"))
    schema = "kind string, value string, gender string, attempt int, s string"
    table = C.cut(found.withColumn("attempt", F.lit(0)).mapInArrow(C.lean(_draw(key)), schema), "entities")
    space = F.when(F.col("kind").rlike("^(?:given|family):"), "name").otherwise(F.col("kind"))
    for _ in range(rounds):
        spaced = table.withColumn("space", space)
        real = spaced.select(F.col("space").alias("rk"), F.col("value").alias("rv")).distinct()
        first = spaced.groupBy("space", "s").agg(F.min(F.struct("value", "kind")).alias("owner")).select(F.col("space").alias("ok"), F.col("s").alias("os"), "owner")
        marked = spaced.join(first, (F.col("space") == F.col("ok")) & (F.col("s") == F.col("os"))).join(real, (F.col("space") == F.col("rk")) & (F.col("s") == F.col("rv")), "left")
        clash = (F.struct("value", "kind") != F.col("owner")) | F.col("rv").isNotNull()
        again = C.cut(marked.where(clash).select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(C.lean(_draw(key)), schema), "entities-again")
        if again.isEmpty():
            C.discard(again)
            break
        calm = table.join(again.select(F.col("kind").alias("ak"), F.col("value").alias("av")), (F.col("kind") == F.col("ak")) & (F.col("value") == F.col("av")), "left_anti")
        following = C.cut(calm.union(again), "entities")
        C.discard(again)
        C.discard(table)
        table = following
    else:
        raise RuntimeError("surrogates still collide")
    return table.where((F.col("attempt") > 0) | (F.col("gender") != EITHER)).select("kind", "value", "gender", "attempt")


def replace(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: bytes = KEY, broadcast_rows: int = 500_000) -> DataFrame:
    """(id, text, n_entities) of every document, its entities replaced."""
    spark = docs.sparkSession
    C.settle(spark)
    rows = C.pick(docs, k=id_column, t=text_column)
    odd = exceptions(rows, key)
    kind = rows.schema["k"].dataType.simpleString()
    few = odd.limit(broadcast_rows + 1).count() <= broadcast_rows
    known = spark.sparkContext.broadcast({(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in odd.toLocalIterator()} if few else {})
    if few:
        whole = rows.select("k", "t", F.lit(None).cast("array<struct<kind:string,value:string,gender:string,attempt:int>>").alias("odd"))
    else:
        marked = rows.withColumn("v", F.xxhash64("t"))
        own = marked.select("k", "v", "t").mapInArrow(C.lean(_mentions(True)), f"k {kind}, v bigint, kind string, value string, gender string").drop("gender").distinct().join(odd, ["kind", "value"])
        own = own.groupBy("k", "v").agg(F.collect_set(F.struct("kind", "value", "gender", "attempt")).alias("odd")).withColumnRenamed("k", "k2").withColumnRenamed("v", "v2")
        whole = marked.join(own, F.col("k").eqNullSafe(F.col("k2")) & (F.col("v") == F.col("v2")), "left").select("k", "t", "odd")

    def run(batches):
        f = Feistel(key)
        for batch in batches:
            texts, odds = batch.column(1), batch.column(2)
            at = _maybe(texts)
            count = np.zeros(len(texts), np.int32)
            changed = {}
            for i in at:
                attempts = known.value
                if odds[i].is_valid:
                    attempts = {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in odds[i].as_py()}
                text, count[i] = rewrite(texts[i].as_py(), f, attempts)
                if count[i]:
                    changed[i] = text
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(count)], names=["k", "t", "n"])

    return whole.mapInArrow(C.lean(run), f"k {kind}, t string, n int").select(F.col("k").alias(id_column), F.col("t").alias(text_column), F.col("n").alias("n_entities"))
