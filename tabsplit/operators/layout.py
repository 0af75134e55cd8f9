"""Token geometry to lines and columns: greedy clusters by running means, one document at a time.

The clusters depend on the order of tokens, so each document's tokens, which Spark gathers and sorts, are folded in one pass of
a mapInArrow task; what it returns are the lines or columns themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsplit.functions.money import SAFE, parse_money


def normalize_token(text: Column) -> Column:
    """Compatibility characters unified, dashes plain, white space single. Only tokens beyond ASCII need Python."""

    @F.pandas_udf("string")
    def unified(values):
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = F.when(text.rlike(r"[^\x00-\x7F]"), unified(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[‐-―]", "-"), r"\s+", " "))


def upper_median(values: list[float], fallback: float) -> float:
    """The upper median of the positive values, or the fallback."""
    kept = sorted(v for v in values if v > 0)
    return kept[len(kept) // 2] if kept else fallback


def runs(values: list[float], tolerance: float) -> tuple[list[int], list[tuple[float, int]]]:
    """The run of each of ascending values, and every run's mean and count.

    A value joins a run whose mean is within the tolerance. As values ascend and a run that one of them did not reach cannot
    grow any more, that is the last run or none.
    """
    numbers: list[int] = []
    sums: list[list[float]] = []
    for value in values:
        if sums and abs(value - sums[-1][0] / sums[-1][1]) <= tolerance:
            sums[-1][0] += value
            sums[-1][1] += 1
        else:
            sums.append([value, 1])
        numbers.append(len(sums) - 1)
    return numbers, [(total / n, int(n)) for total, n in sums]


def rounded(mean: float) -> int:
    return math.floor(mean + 0.5)


class Page:
    """A document's tokens in the order of their centres: lists by field, and the lines that they form, from the top."""

    def __init__(self, fields: dict[str, list]) -> None:
        self.fields = fields
        self.medium = upper_median(fields["height"], 0.0)
        numbers, means = runs(fields["centre"], max(6.0, 0.6 * (self.medium or 12.0)))
        parts: list[list[int]] = [[] for _ in means]
        for k, n in enumerate(numbers):
            parts[n].append(k)
        x, number, y = fields["x"], fields["token_no"], fields["y"]
        for part in parts:
            part.sort(key=lambda k: (x[k], number[k]))
        self.lines = sorted(parts, key=lambda part: min(y[k] for k in part))

    def rights(self) -> list[float]:
        return [x + w for x, w in zip(self.fields["x"], self.fields["width"], strict=True)]

    def box(self, line: list[int]) -> tuple[float, float, float, float]:
        """left, top, right and bottom of what encloses a line."""
        x, y, w, h = (self.fields[c] for c in ("x", "y", "width", "height"))
        return min(x[k] for k in line), min(y[k] for k in line), max(x[k] + w[k] for k in line), max(y[k] + h[k] for k in line)

    def columns(self) -> list[tuple[int, int]]:
        """Centre and count of the columns of numbers: right edges that lie together, two at least."""
        edges = sorted(e for e, numeric in zip(self.rights(), self.fields["numeric"], strict=True) if numeric)
        return [(rounded(mean), n) for mean, n in runs(edges, max(18.0, 1.1 * self.medium))[1] if n >= 2]

    def ranked(self) -> list[tuple[int, int]]:
        """Centre and count of where lines put their last number, the largest first."""
        rights, numeric = self.rights(), self.fields["numeric"]
        last = [rights[numbers[-1]] for line in self.lines if (numbers := [k for k in line if numeric[k]])]
        found = runs(sorted(last), max(20.0, 1.5 * self.medium))[1]
        return [(rounded(mean), n) for mean, n in sorted(found, key=lambda c: -c[1])]

    def amount_column(self, ranked: list[tuple[int, int]]) -> int | None:
        """The largest of them, where it has three lines and half as many again as the next; else no column is better."""
        most, following = (ranked[0][1], ranked[1][1] if len(ranked) > 1 else 0) if ranked else (0, 0)
        return ranked[0][0] if most >= 3 and most >= 1.5 * following else None


TOKEN = "struct<token_no: bigint, text: string, x: double, width: double, confidence: double>"


def documents_of(tokens: DataFrame, *more: str) -> DataFrame:
    """One row a document: its tokens from top to bottom by their centres, then from left to right."""
    fields = [(F.col("y") + F.col("height") / 2).alias("centre"), "x", "token_no", "text", "y", "width", "height", *more]
    own = [F.first(c).alias(c) for c in ("image_width",) if c in tokens.columns]
    return tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tokens"), *own)


def numeric_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with `numeric`: whether they hold a digit and an amount. Only one of over 13 characters can be too large for an amount."""
    amount = F.when(F.length("text") <= 13, True).otherwise(parse_money(F.col("text")).isNotNull())
    return tokens.withColumn("numeric", F.coalesce(F.when(F.col("text").rlike("[0-9]"), amount), F.lit(False)))


def normalized(text: str) -> str:
    """normalize_token() of one text."""
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[‐-―]", "-", unicodedata.normalize("NFKC", text))).strip(" ")


def is_numeric(text: str) -> bool:
    """numeric_tokens() of one text."""
    marked = text
    for letters, digit in (("Oo", "\ue000"), ("Il", "\ue001")):
        marked = re.sub(f"(?<=[0-9.,])[{letters}]|[{letters}](?=[0-9.,])", digit, marked)
    value = re.sub("[^0-9,.]", "", marked.replace("\ue000", "0").replace("\ue001", "1"))
    fraction = re.search(r"[.,]([0-9]{1,2})\Z", value)
    major = re.sub("[.,]", "", value[: fraction.start()] if fraction else value) or "0"
    return bool(re.search("[0-9]", text)) and len(major) <= 16 and int(major) * 100 + int((fraction[1] if fraction else "").ljust(2, "0")) <= SAFE


def cleaned(fields: dict[str, list]) -> dict[str, list]:
    """A document's fields with its odd texts as clean_tokens() and numeric_tokens() would have them."""
    odd = fields.pop("odd", ())
    for k in [k for k, x in enumerate(odd) if x]:
        fields["text"][k] = normalized(fields["text"][k])
        if "numeric" in fields:
            fields["numeric"][k] = is_numeric(fields["text"][k])
    kept = [k for k, t in enumerate(fields["text"]) if t or not odd]
    return {name: [values[k] for k in kept] for name, values in fields.items()} if len(kept) < len(fields["text"]) else fields


#: How many documents of a batch are lists in Python at a time.
AT_ONCE = 500


def pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
    """Of each document of a batch its place and page."""
    for start in range(0, batch.num_rows, AT_ONCE):
        held = batch.column("tokens").slice(start, AT_ONCE)
        flat = held.flatten()
        told = {}
        for field in held.type.value_type:
            values = pc.struct_field(flat, field.name)
            told[field.name] = values.to_pylist() if values.null_count or pa.types.is_string(field.type) else values.to_numpy(zero_copy_only=False).tolist()
        at = 0
        for k, n in enumerate(pc.list_value_length(held).to_pylist(), start):
            yield k, Page(cleaned({name: column[at : at + (n or 0)] for name, column in told.items()}))
            at += n or 0


def listed(sizes: list[int | None], values: pa.Array) -> pa.ListArray:
    """values cut into lists of the given sizes, or null."""
    ends = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([n is None for n in sizes]))


LINE = "line_no long, text string, left double, top double, right double, bottom double"


def folded(documents: DataFrame, geometry: bool) -> DataFrame:
    """The lines of documents_of(): doc_id, number, text and box; with geometry their tokens and the document's columns as well, and its
    image_width if it has that. A document without tokens has the lines of its text, if it has one."""
    sized, texts = geometry and "image_width" in documents.columns, "text" in documents.columns
    numbers = pa.struct([("token_no", pa.int64()), ("text", pa.string()), ("x", pa.float64()), ("width", pa.float64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, out, sizes, flat, found = [], [], [], [[] for _ in numbers], []
            plain = batch.column("text").to_pylist() if texts else ()
            for k, page in pages_of(batch):
                f, told = page.fields, None
                if texts and not page.lines and plain[k] is not None:
                    for n, line in written_lines(plain[k]):
                        places.append(k)
                        out.append((n, line, None, None, None, None))
                        found.append((None, None))
                        sizes.append(None)
                for n, line in enumerate(page.lines):
                    places.append(k)
                    out.append((n, " ".join(f["text"][i] for i in line), *page.box(line)))
                    if geometry:
                        told = told or (page.amount_column(page.ranked()), [c for c, _ in page.columns()])
                        found.append(told)
                        sizes.append(len(line))
                        for values, field in zip(flat, numbers, strict=True):
                            values += [f[field.name][i] for i in line]
            if out:
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.string(), *[pa.float64()] * 4), strict=True)]
                names = ["doc_id", "line_no", "text", "left", "top", "right", "bottom"]
                if geometry:
                    held = pa.StructArray.from_arrays([pa.array(v, field.type) for v, field in zip(flat, numbers, strict=True)], fields=list(numbers))
                    columns += [listed(sizes, held), pa.array([c for c, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))]
                    names += ["tokens", "amount_column", "columns"]
                    if sized:
                        columns.append(batch.column("image_width").take(pa.array(places, pa.int32())))
                        names.append("image_width")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int32())), *columns], names)

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, {LINE}" + (f", tokens array<{TOKEN}>, amount_column long, columns array<long>" if geometry else "")
    schema += f", image_width {dict(documents.dtypes)['image_width']}" if sized else ""
    return documents.mapInArrow(run, schema)


def written_lines(text: str) -> Iterator[tuple[int, str]]:
    """The lines of plain text and their numbers: blank ones count, but are left out."""
    for n, line in enumerate(re.split("\r?\n", text)):
        if kept := line.strip(" \t\n\x0b\f\r"):
            yield n, kept


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with clean texts, without blank ones. Those beyond ASCII are `odd`: the fold cleans them, as it is in Python anyhow, and a
    function before it would cost the tokens their partitioning by document."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    odd = F.col("text").rlike(r"[^\x00-\x7F]")
    return tokens.withColumns({"odd": odd, "text": F.when(odd, F.col("text")).otherwise(plain)}).where("text <> ''")


def boxed(tokens: DataFrame) -> DataFrame:
    return tokens.where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")


def detect_lines(tokens: DataFrame) -> DataFrame:
    """doc_id, line_no, text, and the box of every line, of tokens (doc_id, token_no, text, x, y, width, height)."""
    return folded(documents_of(clean_tokens(tokens), "odd"), geometry=False)


def with_geometry(tokens: DataFrame) -> DataFrame:
    """documents_of() clean tokens that have a box, with all that lines need of them."""
    known = numeric_tokens(clean_tokens(boxed(tokens))).withColumn("confidence", F.col("confidence").cast("double"))
    return documents_of(known, "numeric", "odd", "confidence")


def read_lines(tokens: DataFrame) -> DataFrame:
    """detect_lines' rows with each line's tokens (token_no, text, x, width, confidence), and on every line of a document the
    column of its amounts, or null, and the centres of its columns of numbers. tokens also have a confidence.

    Tokens without a box (x is null) have no line.
    """
    return folded(with_geometry(tokens), geometry=True)


def lines_of_readings(readings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Lines for parse.parsed_bills: of the tokens where a reading has any with a box, else of its text.

    readings are (doc_id, text, image_width), one row a reading; image_width may be null. A reading without either has no line.
    Tokens are gathered by document before these meet their readings, one row each, so that no token and no line is joined with anything.
    """
    drawn = with_geometry(tokens.drop("image_width"))
    both = drawn.join(readings.select("doc_id", "text", "image_width"), "doc_id", "full")
    return folded(both, geometry=True).select(F.col("doc_id").alias("bill_id"), "line_no", F.col("text").alias("line"), "tokens", "amount_column", "columns", "image_width")


def with_lines(tokens: DataFrame) -> DataFrame:
    """doc_id, token_no and line_no of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, page.fields["token_no"][i], n) for k, page in pages_of(batch) for n, line in enumerate(page.lines) for i in line]
            if rows:
                places, numbers, lines = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int32())), pa.array(numbers, pa.int64()), pa.array(lines, pa.int64())], ["doc_id", "token_no", "line_no"])

    return documents_of(tokens).mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, token_no long, line_no long")


COLUMNS = "array<struct<centre: long, count: long>>"


def detect_columns(tokens: DataFrame) -> DataFrame:
    """doc_id, its numeric columns (centre, count), the clusters of the lines' last amounts from the largest on, the amount
    column's centre or null, the upper median of token heights and the ascending right edges of the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("centre", pa.int64()), ("count", pa.int64())]))
        for batch in batches:
            pages = [page for _, page in pages_of(batch)]
            ranked = [page.ranked() for page in pages]
            columns = [pa.array([[{"centre": c, "count": n} for c, n in x] for x in found], kind) for found in ([page.columns() for page in pages], ranked)]
            best = pa.array([page.amount_column(r) for page, r in zip(pages, ranked, strict=True)], pa.int64())
            edges = pa.array([sorted(e for e, numeric in zip(page.rights(), page.fields["numeric"], strict=True) if numeric) for page in pages], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, best, pa.array([page.medium for page in pages], pa.float64()), edges], ["doc_id", "columns", "ranked", "amount_column", "medium", "edges"])

    schema = f"doc_id {dict(tokens.dtypes)['doc_id']}, columns {COLUMNS}, ranked {COLUMNS}, amount_column long, medium double, edges array<double>"
    return documents_of(numeric_tokens(tokens), "numeric").mapInArrow(run, schema)


def level_counts(tokens: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, token_no and on how many of the document's tokens' level, its own included, each token lies: as many as on_level() has pairs of it.

    A window over the tops, so that tokens that lie by document already are not dealt again. Tokens without a finite top have no level.
    """
    near = F.expr(f"count(*) OVER (PARTITION BY doc_id ORDER BY y RANGE BETWEEN {float(tolerance)}D PRECEDING AND {float(tolerance)}D FOLLOWING)")
    known = tokens.withColumn("y", F.col("y").cast("double")).where(F.abs("y") < float("inf"))
    return known.select("doc_id", "token_no", near.alias("level"))


def on_level(tokens: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of a document's tokens whose tops differ by the tolerance at most, by bands: a token meets its own band and the next ones."""
    band = F.floor(F.col("y") / tolerance)
    left = tokens.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    right = tokens.select(F.col("doc_id").alias("_doc"), F.col("token_no").alias("other_no"), F.col("y").alias("other_y"), band.alias("_at"))
    return left.join(right, (F.col("doc_id") == F.col("_doc")) & (F.col("_band") == F.col("_at")) & (F.abs(F.col("y") - F.col("other_y")) <= tolerance)).drop("_band", "_at", "_doc")
