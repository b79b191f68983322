"""Personal data: fixed forms as seeds, and more of it by bootstrapped contexts.

Forms (email, ip, card, phone) give seeds. The two words before a seed are its pattern. Patterns and
instances make a graph: a pattern is trusted for a kind as far as the identifier-like instances that
follow it are trusted to be of that kind, an instance as far as its patterns are. Both are scored in
turn, over all documents. What follows a pattern of high confidence and
enough different instances is personal data of its kind, although no form knows it.

Documents are read once; after that only short rows of mentions are joined and shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.common import batches_of, schema_of, with_row
from headroom.session import settle

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_INSTANCES = 5  # different ones that a trusted pattern has to have
LEAST_CONFIDENCE = 0.8
_TEXT_BYTES = 1 << 22
_CONTEXT = 60  # characters before a mention in which its two words are looked for

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried once, at its beginning: what fails there fails further in
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"\S+")
_CONTEXT_WORD = re.compile(r"[^\W\d_]+|[=:#]")
_OUTSIDE = ".,;:!?()[]{}<>\"'`*|&%$#"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign "at" with the longest run of letters allowed before it and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        begin = free + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _passes_luhn(digits: list[int]) -> bool:
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def forms(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(kind, begin, end)`` of the fixed forms, in code points, by kind and place."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = [int(c) for c in m[0] if c not in " -"]
            if 13 <= len(digits) <= 19 and _passes_luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _context(text: str, begin: int) -> int:
    """Hash of the last two words, or signs of assignment, before a place."""
    words = _CONTEXT_WORD.findall(text[max(0, begin - _CONTEXT) : begin].lower())[-2:]
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63 if len(words) == 2 else 0


def _instance(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.lower()) - 2**63


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """``(begin, end, pattern, instance, kind)``: seeds, and with kind -1 other words that look like identifiers.

    Those hold a digit or the sign "at" and have 4 to 64 characters without punctuation around them; words that touch a
    seed are left out, and so is what has no two words before it.
    """
    out = [(b, e, _context(text, b), _instance(text[b:e]), kind) for kind, b, e in base]
    if base or "@" in text or _DIGIT.search(text):
        taken = sorted((b, e) for _, b, e in base)
        nth = 0
        for m in _TOKEN.finditer(text):
            word = m[0]
            if "@" not in word and not _DIGIT.search(word):
                continue
            while nth < len(taken) and taken[nth][1] <= m.start():
                nth += 1
            if any(b < m.end() for b, _ in taken[nth : nth + 1]):
                continue
            inner = word.strip(_OUTSIDE)
            if 4 <= len(inner) <= 64 and ("@" in inner or _DIGIT.search(inner)):
                begin = m.start() + len(word) - len(word.lstrip(_OUTSIDE))
                out.append((begin, begin + len(inner), _context(text, begin), _instance(inner), -1))
    return [row for row in out if row[2]]


_SPAN = "struct<kind: int, begin: bigint, end: bigint>"
_MENTION = "struct<begin: bigint, end: bigint, pattern: bigint, instance: bigint, kind: int>"


def with_mentions(rows: DataFrame) -> DataFrame:
    """``row, base, mentions`` of a table of ``row, text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))
        names = ("begin", "end", "pattern", "instance", "kind")
        mention = pa.list_(pa.struct([(n, pa.int32() if n == "kind" else pa.int64()) for n in names]))
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [forms(t) for t in texts]
                found = [[dict(zip(names, m)) for m in mentions(t, b)] for t, b in zip(texts, base)]
                spans = [[{"kind": k, "begin": b, "end": e} for k, b, e in own] for own in base]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(spans, span), pa.array(found, mention)], ["row", "base", "mentions"])

    return rows.mapInArrow(read, schema_of(rows, ["row"], f"base array<{_SPAN}>, mentions array<{_MENTION}>"))


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind`` of high confidence, from mentions ``pattern, instance, kind``.

    An edge counts once, however often a pattern and an instance meet, so that copies of a document
    add no weight. The confidence of a pattern in a kind is the mean trust in its instances;
    that of an unknown instance is the chance that one of its patterns is right. Seeds stay at 1.
    """
    edges = settle(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct().withColumn("trust", F.lit(1.0))
    trust = seeds
    for nth in range(rounds):
        weighed = edges.select("pattern", "instance").join(trust, "instance")
        scored = weighed.groupBy("pattern", "kind").agg(F.sum("trust").alias("trust"), F.count("*").alias("known"))
        patterns = scored.join(sizes, "pattern").select("pattern", "kind", "known", (F.col("trust") / F.col("instances")).alias("confidence"))
        patterns = settle(patterns.where((F.col("known") >= LEAST_INSTANCES) & (F.col("confidence") >= LEAST_CONFIDENCE)))
        if nth == rounds - 1 or patterns.isEmpty():
            break
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        learned = edges.where("kind < 0").join(patterns, "pattern").select("instance", patterns["kind"], "confidence")
        learned = learned.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("trust"))
        trust = settle(seeds.unionByName(learned))
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best.select("pattern", "kind")


def with_spans(docs: DataFrame, *columns: str) -> DataFrame:
    """``row`` (the named columns, or all), ``base`` and ``spans``, by kind and place.

    Spans are ``(kind, begin, end)`` in code points, end exclusive, kinds numbered as in ``KINDS``;
    ``spans`` are those of ``base`` and what trusted patterns add. Null texts are empty. Every row of ``docs``
    gives one row; rows that repeat an id are told apart by their place in the written mentions.
    """
    rows = with_row(docs, "text") if not columns else docs.select(F.struct(*columns).alias("row"), "text")
    marked = settle(with_mentions(rows).withColumn("at", F.monotonically_increasing_id()))
    found = marked.select("at", F.explode("mentions").alias("m")).select("at", "m.*")
    patterns = trusted_patterns(found).withColumnRenamed("kind", "as_kind")
    added = found.where("kind < 0").join(patterns, "pattern")
    added = added.groupBy("at").agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), "begin", "end")).alias("added"))
    joined = marked.join(added, "at", "left")
    empty = F.array().cast(f"array<{_SPAN}>")
    return joined.select("row", "base", F.array_sort(F.concat("base", F.coalesce("added", empty))).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:begin:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and ``n_chars``, if there, renewed.

    Spans that overlap are one, named after the first. Null texts stay null.
    """

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _TEXT_BYTES):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    if text is None:
                        out.append(None)
                        continue
                    pieces, done = [], 0
                    for span in sorted(spans, key=lambda s: (s["begin"], s["end"])):
                        if span["begin"] >= done:
                            pieces += [text[done : span["begin"]], f"[{KINDS[span['kind']].upper()}]"]
                        done = max(done, span["end"])
                    out.append("".join([*pieces, text[done:]]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string())], ["row", "clean_text"])

    marked = with_spans(docs).select("row", F.col("row.text").alias("text"), "spans")
    clean = marked.mapInArrow(redact, schema_of(marked, ["row"], "clean_text string"))
    columns = []
    for name in docs.columns:
        column = F.col(f"row.`{name}`")
        if name == "text":
            column = F.col("clean_text")
        elif name == "n_chars":
            column = F.length("clean_text").cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return clean.select(*columns)
