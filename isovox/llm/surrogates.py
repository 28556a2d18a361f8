"""Personal data replaced by surrogates: keyed, of the same type and format, and one for one.

A surrogate comes from a keyed permutation of all values of the entity's format (a Feistel network with cycle
walking, then a step along one cycle, so that nothing is its own surrogate). Equal entities get equal surrogates
in every document without a table to look up, and different ones get different ones. Case, punctuation, scripts
and lengths stay; so do check digits' validity, and the gender and script of names. Digits of any script are read
by their value and written in their script; a letter of any script is replaced among its own kind. A value that has
nothing to permute, or whose permutations all collide, gets an opaque surrogate from a keyed hash.

The key is the caller's; the query and the pipeline take it from the session's setting ``KEY_SETTING``.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from isovox.llm import _text
from isovox.store import columns, dropped, fresh, spare, written

#: The session's setting with the key; Spark redacts settings of such a name where it shows them.
KEY_SETTING = "spark.isovox.surrogates.secret"
#: Attempts by permutation; later ones are opaque.
ATTEMPTS = 3

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Of entities that begin at one place, the first kind here holds.
KINDS = ("email", "secret", "iban", "ip", "phone", "ssn", "card", "name")
#: What stands before an @, in reverse, and what stands after it.
LOCAL, DOMAIN = re.compile(r"[\w%+\-][\w.%+\-]*"), re.compile(r"[^\W_][\w\-]*(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
#: A named secret is the group, if it has a letter or a digit: rules and blanks to fill in are none. Others are long
#: hexadecimal words.
NAMED = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?((?=[+/_\-]*[A-Za-z0-9])[A-Za-z0-9+/_\-]{8,})")
HEXED = re.compile(r"(?<!\w)(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}(?!\w)")
#: All that begins with a digit (of any script), a sign or two capitals and digits.
NUMBERS = re.compile(
    r"(?<!\w)(?P<iban>[A-Z]{2}[0-9]{2}(?=[A-Z0-9]*[0-9])[A-Z0-9]{11,30})(?!\w)"
    rf"|(?<![\d.])(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?!\d|\.\d)"
    r"|(?<![\w+])(?P<phone>(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-]))"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?<![\w.\-])(?P<card>\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7})(?![\w\-])"
)
FEMALE, MALE = "Mrs\\.? |Ms\\.? |Miss |Frau |Mme\\.? |Mlle\\.? |Sra\\.? |Srta\\.? |Г-жа |Κα ", "Mr\\.? |Herr |Sr\\. |Г-н |Κος "
NAME = regex.compile(rf"(?<!\w)(?:{FEMALE}|{MALE})(?P<name>\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?)(?!\w)")
WORD = regex.compile(r"(?<!\w)\p{Lu}\p{Ll}+(?!\w)")
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Julia Laura Maria Marta Nora Sofia".split(),
    ("latin", "m"): "Adam Daniel David Felix Hugo Jonas Leo Lucas Martin Oscar".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга София".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Егор Иван Леонид Олег Павел".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Letters that stand for one another, so that a name stays in its script and can be spoken.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñßšžčř", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αειουηω", "βγδζθκλμνξπρστφχψ"]
_OF = {c: kind for kind in LETTERS for c in kind}
#: Country codes of two digits; +1 and +7 have one, all others three. No code begins with another.
TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _whole(c: str) -> bool:
    """Whether a lower-case letter has a capital of its own, so that its case can be put back."""
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


@lru_cache(65536)
def kind_of(c: str) -> str | None:
    """The characters that one (in lower case) may be replaced by, itself among them; None: it stays.

    A digit has those of its script, a listed letter its list. Others have the letters of the same category, with or
    without a capital as it, among the 64 code points around them.
    """
    value = unicodedata.decimal(c, None)
    if value is not None:
        return "".join(chr(ord(c) - value + i) for i in range(10))
    if c in _OF:
        return _OF[c]
    if not c.isalpha():
        return None
    first = ord(c) & ~63
    near = [x for x in map(chr, range(first, first + 64)) if x not in _OF and _low(x) == x and unicodedata.category(x) == unicodedata.category(c) and _whole(x) == _whole(c)]
    return "".join(near) if len(near) > 1 and c in near else None


def ascii_digits(value: str) -> str:
    """``value`` with the digits of all scripts as 0-9."""
    return value if value.isascii() else "".join(c if (d := unicodedata.decimal(c, None)) is None else DIGITS[d] for c in value)


class Cipher:
    """Keyed permutations of whole numbers under n, without a fixed point where n is over 1."""

    def __init__(self, key: bytes, opaque: bool = False):
        self.key, self.opaque = key, opaque
        self.turned = lru_cache(200_000)(self._turned)
        self.others: dict[int, Cipher] = {}

    def other(self, again: int) -> Cipher:
        """The cipher of the ``again``th attempt at an entity whose surrogate collides; of attempt 0, this one."""
        if again and again not in self.others:
            self.others[again] = Cipher(self.key + b"|again|%d" % again, again >= ATTEMPTS)
        return self.others[again] if again else self

    def hidden(self, kind: str, value: str) -> str:
        """An opaque word in place of a value: a capital and lower-case letters from 95 bits of a keyed hash."""
        x = int.from_bytes(hmac.digest(self.key, f"{kind}|{value}".encode("utf-8", "surrogatepass"), "sha256")[:16], "big")
        out = ""
        for _ in range(20):
            x, i = divmod(x, 26)
            out += LATIN[i]
        return out.capitalize()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        raw = hashlib.shake_256(b"%d|%d|" % (len(self.key), i) + self.key + tweak + b"|" + half.to_bytes(size, "big")).digest(size)
        return int.from_bytes(raw, "big") >> (8 * size - bits)

    def _walk(self, tweak: bytes, x: int, n: int, back: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in range(7, -1, -1) if back else range(8):
                if back:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def _turned(self, tweak: bytes, x: int, n: int) -> int:
        if n < 2:
            return x
        return self._walk(tweak, (self._walk(tweak, x, n, False) + 1) % n, n, True)

    def text(self, tweak: str, value: str, kinds: Callable[[str], str | None]) -> str:
        """``value`` with each character for one of its kind; those without a kind stay and are part of the format."""
        groups = [kinds(c) for c in value]
        form = f"{tweak}|" + "".join(c if g is None else f"<{g[0]}>" for c, g in zip(value, groups, strict=True))
        x, n = 0, 1
        for c, g in zip(value, groups, strict=True):
            if g is not None:
                x, n = x * len(g) + g.index(c), n * len(g)
        x = self.turned(form.encode(), x, n)
        out = []
        for c, g in zip(reversed(value), reversed(groups), strict=True):
            if g is None:
                out.append(c)
            else:
                x, i = divmod(x, len(g))
                out.append(g[i])
        return "".join(reversed(out))


DIGITS, LATIN, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _alnum(c: str) -> str | None:
    return LATIN if c in LATIN else kind_of(c)


def recased(pattern: str, value: str) -> str:
    return "".join(v.upper() if p.isupper() and len(v.upper()) == 1 else v for p, v in zip(pattern, value, strict=True))


def _low(value: str) -> str:
    """In lower case, character by character, so that places stay."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def _check_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _country(digits: str) -> int:
    """The length of the country code, from the digits alone, however the number is spaced."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in TWO else 3


def surrogate(cipher: Cipher, kind: str, value: str) -> str:
    """The replacement of an entity: of any way to write it, the same value written that way.

    Never the value itself: what no permutation can change becomes opaque.
    """
    new = "" if cipher.opaque else _permuted(cipher, kind, value)
    if not new or canonical(kind, new) == canonical(kind, value):
        word = cipher.hidden(kind, canonical(kind, value))
        return f"{word[:12].lower()}@{word[12:].lower()}.{value.rpartition('.')[2]}" if kind == "email" else word
    return new


def _permuted(cipher: Cipher, kind: str, value: str) -> str:
    if kind == "name":
        return name_surrogate(cipher, value)
    if kind == "email":
        local, _, domain = _low(value).rpartition("@")
        labels, _, top = domain.rpartition(".")
        head = cipher.text(f"email|{top}", f"{local}@{labels}", _alnum)
        return recased(value, f"{head}.{top}")
    if kind == "secret":
        low = _low(value)
        if all(c in HEX for c in low):
            new = cipher.text("hex", low, lambda c: HEX)
            return new.upper() if value.isupper() else new
        return cipher.text("secret", value, lambda c: DIGITS if c in DIGITS else LATIN if c in LATIN else LATIN.upper() if c in LATIN.upper() else None)
    if kind == "iban":
        return value[:2] + cipher.text(f"iban|{value[:2]}", value[2:], lambda c: DIGITS if c in DIGITS else LATIN.upper())
    if kind == "ip":
        x = 0
        for octet in value.split("."):
            x = x * 256 + int(octet)
        x = cipher.turned(b"ip", x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    plain = ascii_digits(value)
    digits = "".join(c for c in plain if c in DIGITS)
    if kind == "card":
        delta = (int(digits[-1]) - _check_digit(digits[:-1])) % 10
        head = cipher.text(f"card|{delta}", digits[:-1], lambda c: DIGITS)
        made = head + str((_check_digit(head) + delta) % 10)
    else:
        keep = _country(digits) if value[0] == "+" else 0
        made = digits[:keep] + cipher.text(f"{kind}|{digits[:keep]}", digits[keep:], lambda c: DIGITS)
    each = iter(made)
    return "".join(_as(next(each), c) if p in DIGITS else c for c, p in zip(value, plain, strict=True))


def _as(digit: str, like: str) -> str:
    """A digit 0-9 in the script of another digit."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit))


_EVERY = {name: (names, script, gender) for (script, gender), names in GIVEN.items() for name in names}


def name_surrogate(cipher: Cipher, word: str) -> str:
    """A given name of the lists for one of the same script and gender; other names letter for letter.

    Their last letter, which tells the gender of many, stays. A name's surrogate doesn't follow the title it stands
    with, so a family has one name in all documents.
    """
    if word in _EVERY:
        listed, script, gender = _EVERY[word]
        return listed[cipher.turned(f"given|{script}|{gender}".encode(), listed.index(word), len(listed))]
    new = word
    while True:  # a walk along the permutation's cycle ends outside the lists, at the latest where it began
        low = _low(new)
        new = recased(word, cipher.text("name", low[:-1], kind_of) + low[-1])
        if new not in _EVERY:
            return new


def _before(text: str, low: int, at: int) -> int:
    """Where the local part that ends before ``at`` begins, not before ``low``; ``at`` if there is none."""
    size = 64
    while True:
        begin = max(low, at - size)
        found = LOCAL.match(text[begin:at][::-1])
        if not found or found.end() < at - begin or begin == low:
            return at - (found.end() if found else 0)
        size *= 4


def _spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of all but names. Each search is anchored, so that its work follows the text's length."""
    at, last = text.find("@"), 0
    while at >= 0:
        begin = _before(text, last, at)
        after = DOMAIN.match(text, at + 1) if begin < at else None
        if after:
            yield begin, after.end(), "email"
        last = at + 1
        at = text.find("@", after.end() if after else last)
    if "=" in text or ":" in text:
        for m in NAMED.finditer(text):
            yield *m.span(1), "secret"
    for m in HEXED.finditer(text):
        yield *m.span(), "secret"
    for m in NUMBERS.finditer(text):
        kind = next(k for k in ("iban", "ip", "phone", "ssn", "card") if m[k] is not None)
        yield *m.span(kind), kind


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what is found, in order and without overlap."""
    found = [(a, b, k, text[a:b]) for a, b, k in _spans(text)]
    names = {word for m in NAME.finditer(text) for word in m["name"].split()}
    if names:
        # Every mention of such a name in the text, with or without a title.
        found += [(*m.span(), "name", m[0]) for m in WORD.finditer(text) if m[0] in names]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    kept, end = [], 0
    for x in found:
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


def replaced(cipher: Cipher, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, end, kind, value) of each: where it stands now, and what stood there."""
    parts, made, at, size = [], [], 0, 0
    for start, end, kind, value in entities(text):
        new = surrogate(cipher, kind, value)
        parts += [text[at:start], new]
        size += start - at
        made.append((size, size + len(new), kind, value))
        size += len(new)
        at = end
    return "".join(parts) + text[at:], made


def canonical(kind: str, value: str) -> str:
    """One form for all ways to write an entity."""
    if kind in ("phone", "ssn", "card"):
        return value if value.isalpha() else "".join(c for c in ascii_digits(value) if c in DIGITS + "+")
    cased = kind == "name" or (kind == "secret" and not all(c in HEX for c in _low(value)))
    return value if cased else _low(value)


#: A text without a match has no entity.
HINT = r"[\p{Nd}@]|Mr|Ms|Miss|Frau|Herr|Mme|Mlle|Sr|Г-|Κ[αο]|(?i:token|secret|passw|key)"


def _marked(column: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(column, HINT), False).to_pylist()


#: What a replaced text keeps of each entity: its place now, its kind, what stood there, and the canonical forms of both.
FOUND = StructType([*(StructField(n, LongType()) for n in ("start", "end")), *(StructField(n, StringType()) for n in ("kind", "value", "form", "made"))])
_FOUND = pa.list_(pa.struct([*((n, pa.int64()) for n in ("start", "end")), *((n, pa.string()) for n in ("kind", "value", "form", "made"))]))


def _told(text: str, start: int, end: int, kind: str, value: str) -> dict:
    return {"start": start, "end": end, "kind": kind, "value": value, "form": canonical(kind, value), "made": canonical(kind, text[start:end])}


def _found(docs: DataFrame, key: bytes, text: str, found: str) -> DataFrame:
    """``docs`` with its text replaced and a last column ``found`` of its entities."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(found, ArrayType(FOUND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for part in _text.chunks(batches, text):
            bodies, told = part.column(text).to_pylist(), []
            for i, marked in enumerate(_marked(part.column(text))):
                made: list[tuple[int, int, str, str]] = []
                if marked:
                    bodies[i], made = replaced(cipher, bodies[i])
                told.append([_told(bodies[i], *m) for m in made])
            columns = [pa.array(bodies, pa.string()) if c == text else part.column(j) for j, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, _FOUND)], [*names, found])

    return docs.mapInArrow(run, schema)


def collisions(found: DataFrame) -> DataFrame:
    """(kind, value) of (kind, value, surrogate) rows to be made anew: one row each.

    Of entities that share a surrogate, of whatever kinds, all but the first; entities with more than one; entities
    that are their own.
    """
    once = found.distinct()
    first = W.partitionBy("surrogate").orderBy(*(["again"] if "again" in found.columns else []), "kind", "value")
    shared = once.withColumn("nth", F.dense_rank().over(first)).where("nth > 1").select("kind", "value")
    split = once.groupBy("kind", "value").agg(F.count_distinct("surrogate").alias("n")).where("n > 1").select("kind", "value")
    return shared.union(split).union(once.where("value = surrogate").select("kind", "value")).distinct()


def resolved(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, again) of the entities of ``found`` that need another attempt, for no surrogate to collide.

    Each round makes the colliding ones anew and holds them against all. Attempts from ``ATTEMPTS`` on are opaque, so
    rounds come to an end: a row that collides never fails the job.
    """
    now = written(found.select("kind", "value", "surrogate").distinct().withColumn("again", F.lit(0)), "entities")
    again = 0
    while True:
        bad = written(collisions(now), "colliding")
        if bad.isEmpty():
            return now.where("again > 0").select("kind", "value", "again").distinct()
        again += 1

        def run(batches: Iterator[pa.RecordBatch], again: int = again) -> Iterator[pa.RecordBatch]:
            cipher = Cipher(key).other(again)
            for batch in batches:
                kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
                new = [canonical(k, surrogate(cipher, k, v.upper() if k == "iban" else v)) for k, v in zip(kinds, values, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array(new, pa.string()), pa.array([again] * len(new), pa.int32())], ["kind", "value", "surrogate", "again"])

        anew = bad.mapInArrow(run, "kind string, value string, surrogate string, again int")
        now = written(now.join(bad, ["kind", "value"], "left_anti").union(anew), "entities")


def _again(docs: DataFrame, key: bytes, text: str, found: str, attempts: str) -> DataFrame:
    """Replaced texts with other surrogates for the entities of the column ``attempts`` (kind, form, again)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for part in _text.chunks(batches, text):
            bodies = part.column(text).to_pylist()
            for i, tried in enumerate(part.column(attempts).to_pylist()):
                if not tried:
                    continue
                of, pieces, at = {(x["kind"], x["form"]): x["again"] for x in tried}, [], 0
                for x in part.column(found)[i].as_py():
                    if n := of.get((x["kind"], x["form"])):
                        pieces += [bodies[i][at : x["start"]], surrogate(cipher.other(n), x["kind"], x["value"])]
                        at = x["end"]
                bodies[i] = "".join(pieces) + bodies[i][at:]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if c == text else part.column(j) for j, c in enumerate(names)], names)

    return docs.mapInArrow(run, docs.schema)


def with_surrogates(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced and a last column of the entities' kinds, without the search for collisions.

    That column is ``entity_kinds``, with as many underscores before it as keep it apart from the columns of ``docs``
    in any case of letters. A null text stays null and an empty one empty; texts without an entity stay as they are;
    repeated rows stay equal. All other columns, of any type and name, stay. Whole texts are searched, however long.
    """
    p = fresh(docs, "surrogate")
    return _found(docs, key, text, p + "found").withColumn(spare(docs, "entity_kinds"), F.transform(p + "found", lambda x: x["kind"])).drop(p + "found")


def checked(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``with_surrogates`` and a search of all entities for surrogates that collide; those entities get others.

    Texts are searched once: they are written with their surrogates and what was there. Where two entities (of any
    kinds) share a surrogate or one has two, the texts that have them get another attempt, joined in by value.
    """
    p = fresh(docs, "surrogate")
    found, row, attempts = p + "found", p + "row", p + "again"
    made = written(_found(docs, key, text, found).withColumn(row, F.monotonically_increasing_id()), "surrogates")
    each = made.select(row, F.explode(found).alias("x")).select(row, F.col("x.kind").alias("kind"), F.col("x.form").alias("value"), F.col("x.made").alias("surrogate"))
    once = written(each.select("kind", "value", "surrogate").distinct(), "entities")
    if not collisions(once).isEmpty():
        again = resolved(once, key)
        told = each.join(again, ["kind", "value"]).groupBy(row).agg(F.collect_set(F.struct("kind", F.col("value").alias("form"), "again")).alias(attempts))
        made = _again(made.join(told, row, "left"), key, text, found, attempts)
    dropped(once)
    return made.select(*columns(docs), F.transform(found, lambda x: x["kind"]).alias(spare(docs, "entity_kinds")))


def key_of(spark: SparkSession) -> bytes:
    """The key that the setting ``KEY_SETTING`` holds; where it is unset, a random one that lasts as long as the session.

    Runs that must give equal surrogates need the setting; nobody can undo those of a key that is not kept.
    """
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, named)
    return named.encode()


def op4_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = checked(docs, key_of(spark))
    return made.select("doc_id", "text", F.size("entity_kinds").cast("long").alias("n_entities"), F.array_join("entity_kinds", ",").alias("kinds"))
