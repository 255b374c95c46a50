"""Personal data: regular expressions propose, checksums confirm, nearby words adjust a score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import as_text, bounded_batches, slices, table

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A possessive run of digits: where a match fails at the start of a run, it fails from inside it too.
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_IP_LONG = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LONG_DIGITS = re.compile(r"[0-9]{512}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Prior score of a confirmed span, words that raise it and words that lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
RAISE = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
LOWER = {"email": ("example",), "ip": ("version", "release", "section"), "card": ("isbn", "serial", "order"), "phone": ("version",), "iban": ("serial",)}
REACH, STEP, LEAST = 40, 0.1, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost matches, found from each @: a match starts where the run of local characters before it does."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def ips(text: str):
    pattern = _IP_LONG if _LONG_DIGITS.search(text) else _IP
    for m in pattern.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def ibans(text: str):
    """Account numbers; trailing groups that belong to the next word are given back until mod-97 holds."""
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found.replace(" ", "")) >= 15:
            if mod97(found.replace(" ", "")):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans)))


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH // 2].lower()
    value = PRIOR[kind] + STEP * any(w in around for w in RAISE[kind]) - 3 * STEP * any(w in around for w in LOWER[kind])
    return min(1.0, max(0.0, value))


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans by start, then kind as listed.  Spans of the base kinds stay whatever their score; others need LEAST."""
    found = []
    for order, (kind, find) in enumerate(_FINDERS.items()):
        for start, end in find(text):
            value = score(text, kind, start, end)
            if order < len(BASE) or value >= LEAST:
                found.append((start, order, end, value))
    return [(KINDS[order], start, end, value) for start, order, end, value in sorted(found)]


def redacted(text: str) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans count as one, of the first kind."""
    out, last = [], 0
    for kind, start, end, _ in spans(text):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:] if out else text


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_personal_data(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id and spans (kind, start, end in code points, score).

    Null texts are empty and have no spans; repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches, 1):
            found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    source = as_text(docs.select(F.col(id_column).cast("long").alias("id"), "text"))
    return source.mapInArrow(run, f"id long, spans {SPAN}").withColumnRenamed("id", id_column)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the personal data in text replaced; null texts stay null, n_chars (if there) follows the text, other columns stay."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, place):
            texts = pa.array([None if t is None else redacted(t) for t in batch.column(place).to_pylist()], pa.string())
            columns = list(batch.columns)
            columns[place] = texts
            yield pa.RecordBatch.from_arrays(columns, list(batch.schema.names))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, spans and their digest for every document; nulls, empty texts and repeated rows as find_personal_data states, no spans: empty strings."""
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
