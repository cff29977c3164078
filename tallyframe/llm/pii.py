"""Personal data replaced by surrogates.

Detected entities (e-mail and IP addresses, telephone and social security
numbers, card numbers with a right check digit, account numbers, secrets,
names after a title) are brought
to one canonical form each, and every distinct entity of the corpus gets one
surrogate made by a keyed hash: the same kind and the same format. Rounds of
checks give entities whose surrogate is another's, or is itself a detected
entity, another one, so distinct entities stay distinct and all mentions of one
entity agree in every document. Where a format has few values, later rounds
widen it.

Names are replaced word by word, each distinct word by one distinct word of the
same script, so "Mr. John Smith", "Dr. John Smith" and "Mr. Smith" keep their
common parts whatever their titles. A given name takes the gender of its titles
wherever in the corpus they stand; if they disagree or tell none, it takes none.
In a text with a titled name, that name's words are also replaced where they
stand without a title.

Texts are searched once, and their spans written beside them; only rows that
hold entities are shuffled. Null and empty texts stay as they
are, rows without entities are returned unchanged, repeated rows are rewritten
alike, and all columns are kept; of a report's columns, those that the table has
already are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables
from .tokens import slices, small_batches

# Titles before names, by the gender they tell.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Mister"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
NEUTRAL_TITLES = ["Dr", "Prof", "Доктор"]
# Syllables of invented names.
LATIN = ["ba", "de", "fi", "go", "la", "me", "ni", "ro", "sa", "te", "vi", "lo", "ka", "ru", "pe", "mo"]
CYRILLIC = ["ба", "де", "фи", "го", "ла", "ме", "ни", "ро", "са", "те", "ви", "ло", "ка", "ру", "пе", "мо"]

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))
_UPPER, _LETTERS = "[A-ZÀ-ÖØ-ÞА-ЯЁ]", "[a-zß-öø-ÿа-яё]+"
_CAPITAL = rf"(?:{_UPPER}['’])?{_UPPER}{_LETTERS}(?:[-'’]{_UPPER}{_LETTERS})*"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}(?![\w@]))"
    r"|(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s*(?:=|:)\s*)[\"']?(?P<secret>[A-Za-z0-9+/_=-]{12,})"
    r"|(?P<known>\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})\b)"
    r"|(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]*\d))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))"
    rf"|\b(?P<title>(?i:{_TITLES}))\b\.? (?P<name>{_CAPITAL}(?: {_CAPITAL}){{0,2}})"
)
#: A text with none of these has no entities: a digit or @, an assignment, a title, a key.
SIGN = re.compile(rf"[@0-9=:]|(?i:\b(?:{_TITLES})\b)")
KINDS = ["email", "secret", "known", "ipv6", "ip", "iban", "ssn", "phone", "card", "name"]
_GENDER = {t.casefold(): g for g, titles in (("m", MALE_TITLES), ("f", FEMALE_TITLES)) for t in titles}
_NAME_WORD = re.compile(_CAPITAL)


def _canonical(kind: str, surface: str) -> str:
    """One form for all mentions of an entity."""
    if kind in ("ssn", "card"):
        return re.sub(r"\D", "", surface)
    if kind == "phone":  # with or without the North American country code
        digits = re.sub(r"\D", "", surface)
        return digits[1:] if surface.startswith("+1") and len(digits) == 11 else digits
    if kind == "iban":
        return surface.replace(" ", "")
    if kind in ("email", "ipv6"):
        return surface.lower()
    if kind == "name":
        return f"{'c' if re.search('[А-яЁё]', surface) else 'l'}|{surface.casefold()}"
    return surface


def detect(text: str | None) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, kind, canonical form, gender, first of its mention) of each entity, in order and without overlaps.

    The gender, m or f, is told by a title for the given words of a name; it is empty otherwise.
    """
    if not text or not SIGN.search(text):
        return []
    out, named = [], {}
    for m in ENTITY.finditer(text):
        kind = next(k for k in KINDS if m.group(k) is not None)
        if kind == "card" and not luhn(re.sub(r"\D", "", m.group(kind))):
            continue
        if kind != "name":
            out.append((m.start(kind), m.end(kind), "secret" if kind == "known" else kind, _canonical(kind, m.group(kind)), "", True))
            continue
        words = list(_NAME_WORD.finditer(text, m.start(kind), m.end(kind)))
        for i, w in enumerate(words):
            gender = _GENDER.get(m.group("title").casefold(), "") if i < len(words) - 1 else ""
            out.append((w.start(), w.end(), kind, _canonical(kind, w.group()), gender, i == 0))
            named[w.group()] = None
    if named:
        taken = {a for a, *_ in out}
        spans = [(a, b) for a, b, *_ in out]
        again = re.compile(rf"(?<![\w@.])(?:{'|'.join(map(re.escape, sorted(named, key=len, reverse=True)))})(?![\w@])")
        at, before = 0, -2
        for w in again.finditer(text):
            while at < len(spans) and spans[at][1] <= w.start():
                at += 1
            if w.start() in taken or at < len(spans) and spans[at][0] < w.end():
                continue
            out.append((w.start(), w.end(), "name", _canonical("name", w.group()), "", w.start() != before + 1))
            before = w.end()
        out.sort()
    return out


class Draws:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, what: str):
        self.key, self.what, self.block, self.left = key, what.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.block.to_bytes(4, "big") + self.what, hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _like(chars: str, draws: Draws) -> str:
    """Letters become letters of the same case and alphabet, digits digits; the rest stays."""
    out = []
    for c in chars:
        if c.isdigit():
            out.append(str(draws.below(10)))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr((97 if c.islower() else 65) + draws.below(26)))
        elif "а" <= c <= "я" or "А" <= c <= "Я":
            out.append(chr((0x430 if c.islower() else 0x410) + draws.below(32)))
        elif "à" <= c <= "ÿ" and c != "÷":
            out.append(chr(97 + draws.below(26)))
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _word(draws: Draws, syllables: list[str], n: int) -> str:
    return "".join(syllables[draws.below(len(syllables))] for _ in range(n)).capitalize()


#: Rounds after which a format is widened, each time again.
WIDEN = 6


def surrogate(key: bytes, kind: str, canonical: str, gender: str, attempt: int) -> str:
    """A canonical form of the same kind and format; another one for each attempt, of a wider format after some."""
    draws, wider = Draws(key, f"{kind}|{attempt}|{canonical}"), attempt // WIDEN
    if kind == "ip":
        return ".".join(_octet(min(3, len(part) + wider), draws) for part in canonical.split("."))
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[draws.below(16)] for _ in part) for part in canonical.split(":"))
    if kind == "phone":  # the country's digits stay
        keep = max(0, len(canonical) - 10) if not wider else 0
        return canonical[:keep] + _like(canonical[keep:], draws)
    if kind == "card":
        made = canonical[:1] * (not wider) + _like(canonical[(not wider) :], draws)
        return next(made[:-1] + d for d in "0123456789" if luhn(made[:-1] + d))  # a valid number, too
    if kind == "iban":
        return canonical[:2] + _like(canonical[2:], draws)
    if kind == "email":  # one surrogate for each domain; its last label stays
        local, _, domain = canonical.rpartition("@")
        host, _, last = domain.rpartition(".")
        more = "".join(str(draws.below(10)) for _ in range(2 * wider))
        return f"{_like(local, draws)}{more}@{_like(host, Draws(key, f'domain|{domain}'))}.{last}"
    if kind == "name":
        script, word = canonical.split("|", 1)
        latin = script == "l"
        ending = {"f": "a" if latin else "а", "m": "n" if latin else "н"}.get(gender) or ("s" if latin else "ва" if word.endswith(("а", "ая")) else "в")
        parts = [p if p in "-'’" else _word(draws, LATIN if latin else CYRILLIC, 3 + wider) if len(p) > 1 else _like(p, draws) for p in re.split("([-'’])", word)]
        return f"{script}|{''.join(parts).casefold()}{ending}"
    return _like(canonical, draws) + "".join(str(draws.below(10)) for _ in range(wider))


def _octet(digits: int, draws: Draws) -> str:
    low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[digits]
    return str(low + draws.below(high - low + 1))


def render(kind: str, surface: str, replaced: str) -> str:
    """The surrogate in the format of one mention: its separators and its case."""
    if kind in ("ssn", "phone", "card"):  # digits before the canonical ones, a country code, stay
        digits, code = iter(replaced), sum(c.isdigit() for c in surface) - len(replaced)
        out = []
        for c in surface:
            if c.isdigit():
                code -= 1
                c = next(digits) if code < 0 else c
            out.append(c)
        return "".join(out)
    if kind == "iban":
        chars = iter(replaced)
        return "".join(c if c == " " else next(chars) for c in surface)
    if kind == "email":
        local, at, domain = surface.rpartition("@")
        new = replaced.rpartition("@")
        return _cased(local, new[0]) + at + _cased(domain, new[2])
    if kind == "name":
        word = replaced.split("|", 1)[1]
        return word.upper() if len(surface) > 1 and surface.isupper() else "".join(p.capitalize() for p in re.split("([-'’])", word))
    return _cased(surface, replaced) if kind == "ipv6" else replaced


def _cased(surface: str, replaced: str) -> str:
    """Upper case where the surface has it."""
    return "".join(r.upper() if i < len(surface) and surface[i].isupper() else r for i, r in enumerate(replaced))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string()), ("gender", pa.string()), ("head", pa.bool_())]))
_SPANS_SQL = "array<struct<start:int,end:int,kind:string,canonical:string,gender:string,head:boolean>>"


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with __spans: the entities of each text."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [[dict(zip(("start", "end", "kind", "canonical", "gender", "head"), x, strict=True)) for x in detect(t)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS)], names=[*columns, "__spans"])

    return docs.transform(small_batches).mapInArrow(run, docs.withColumn("__spans", F.lit(None).cast(_SPANS_SQL)).schema)


_ENTITY = ["kind", "canonical", "gender", "attempt"]


def _propose(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, gender, attempt, made) from the first four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *row) for row in zip(*(batch.column(c).to_pylist() for c in _ENTITY), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ENTITY), pa.array(made, pa.string())], names=[*_ENTITY, "made"])

    return entities.select(*_ENTITY).transform(small_batches).mapInArrow(run, "kind string, canonical string, gender string, attempt int, made string")


def assign_surrogates(entities: DataFrame, key: bytes, max_rounds: int = 60) -> DataFrame:
    """(kind, canonical, made): distinct entities (kind, canonical, gender) to distinct surrogates, none of which is an entity."""
    tables = Tables(entities.sparkSession)
    real = entities.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
    now = tables.write(_propose(entities.withColumn("attempt", F.lit(0)), key), "made0")
    for i in range(max_rounds):
        first = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        taken = tables.write(first.join(real, ["kind", "made"], "left").where("n > 1 OR real").withColumn("real", F.coalesce("real", F.lit(False))), f"taken{i}")
        if taken.isEmpty():
            return now.select("kind", "canonical", "made")
        judged = now.join(taken, ["kind", "made"], "left")
        again = F.coalesce(F.col("real") | (F.col("first.canonical") != F.col("canonical")), F.lit(False))
        judged = tables.write(judged.select("kind", "canonical", "gender", "made", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), f"judged{i}")
        now = tables.write(judged.where("NOT again").select(*_ENTITY, "made").unionByName(_propose(judged.where("again"), key)), f"made{i + 1}")
        tables.drop(f"made{i}", f"taken{i}", f"judged{i}")
    raise RuntimeError("surrogates still collide; the format leaves too few values")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", report: bool = False) -> DataFrame:
    """docs with every entity replaced. With report, also n_entities and kinds (sorted, distinct, comma-joined)."""
    extra = ["n_entities", "kinds"] if report else []
    columns = [c for c in docs.columns if c not in extra]
    kept = [*columns, *extra]
    tables = Tables(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in columns))
    found = tables.write(with_spans(docs, text).withColumn("__row", F.monotonically_increasing_id()), "found")
    if report:
        heads = F.filter("__spans", lambda s: s["head"])
        found = found.withColumn("n_entities", F.size(heads).cast("bigint")).withColumn("kinds", F.array_join(F.array_sort(F.array_distinct(F.col("__spans.kind"))), ","))
    hit = F.size("__spans") > 0
    spans = found.where(hit).select("__row", F.explode("__spans").alias("s")).select("__row", "s.*")
    genders = F.collect_set(F.when(F.col("gender") != "", F.col("gender")))  # two values at most
    entities = tables.write(spans.groupBy("kind", "canonical").agg(F.when(F.size(genders) == 1, genders[0]).otherwise("").alias("gender")), "entities")
    made = assign_surrogates(entities, key)
    replaced = spans.join(made, ["kind", "canonical"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "made"))).alias("__made"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = []
            for t, changes in zip(batch.column(text).to_pylist(), batch.column("__made").to_pylist(), strict=True):
                out, at = [], 0
                for c in changes:
                    out += [t[at : c["start"]], render(c["kind"], t[c["start"] : c["end"]], c["made"])]
                    at = c["end"]
                texts.append("".join([*out, t[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept], names=kept)

    joined = found.where(hit).join(replaced, "__row").select(*(f"`{c}`" for c in kept), "__made")
    rewritten = joined.transform(small_batches).mapInArrow(run, joined.drop("__made").schema)
    return found.where(~hit).select(*(f"`{c}`" for c in kept)).unionByName(rewritten)
