"""Best representative of each duplicate group: token-level consensus and field-by-field survivors.

The values of a group are aligned progressively into columns of tokens, every value votes in each column with its
weight, and the existing value closest to the winning tokens survives. A group is read in chunks of about ``CHUNK`` values: each
gives a profile, the columns with all their votes; profiles are aligned to each other and their votes added, level by
level, until a group has one; then every value is compared with its group's consensus, again in chunks. No vote is lost on the way, whatever the
size of a group. With ``priority`` columns instead of weights a value outweighs all values after it together, so a column's vote is the
first value's that stands in it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Values, and profiles, that one task aligns at a time.
CHUNK = 64
#: Cells of an alignment's table that are kept at once; larger ones are halved.
CELLS = 250_000
_TOKEN = regex.compile(r"\w+|[^\w\s]")

GAP = ""


def tokens(text: str) -> list[str]:
    """Words and single marks."""
    return _TOKEN.findall(text)


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of aligning all of ``a`` to each beginning of ``b``."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for x in a:
        now = np.empty_like(row)
        now[0] = row[0] + 1
        now[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(now - steps) + steps
    return row


def _path(a: np.ndarray, b: np.ndarray, i0: int, j0: int, out: list[tuple[int | None, int | None]]) -> None:
    """Appends a cheapest alignment of two arrays: Needleman-Wunsch by rows, halved after Hirschberg where its table would be large."""
    n, m = len(a), len(b)
    if n > 1 and m > 1 and n * m > CELLS:
        half = n // 2
        split = int(np.argmin(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]))
        _path(a[:half], b[:split], i0, j0, out)
        _path(a[half:], b[split:], i0 + half, j0 + split, out)
        return
    steps = np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), dtype=np.int64)
    cost[0] = steps
    for i in range(1, n + 1):
        now = cost[i]
        now[0] = i
        now[1:] = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(now - steps) + steps
    back: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            back.append((i0 + i, j0 + j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            back.append((i0 + i, None))
        else:
            j -= 1
            back.append((None, j0 + j))
    out.extend(reversed(back))


def align(columns: Sequence[str], row: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """A cheapest alignment of ``row`` to ``columns`` (0 for an equal token, 1 for a gap or another token) as index pairs.

    Equal beginnings and ends are matched first.
    """
    lo = 0
    while lo < len(columns) and lo < len(row) and columns[lo] == row[lo]:
        lo += 1
    end = 0
    while end < min(len(columns), len(row)) - lo and columns[-1 - end] == row[-1 - end]:
        end += 1
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(t, len(number)) for t in x[lo : len(x) - end]], dtype=np.int64) for x in (columns, row))
    path: list[tuple[int | None, int | None]] = [(i, i) for i in range(lo)]
    _path(a, b, lo, lo, path)
    return path + [(len(columns) - end + i, len(row) - end + i) for i in range(end)]


class Profile:
    """Columns of votes by token, :data:`GAP` included, and the vote of all values together."""

    def __init__(self, columns: list[dict], vote: object, add: Callable, best: Callable) -> None:
        self.columns, self.vote, self.add, self.best = columns, vote, add, best

    @classmethod
    def of(cls, row: list[str], vote: object, add: Callable, best: Callable) -> Profile:
        return cls([{t: vote} for t in row], vote, add, best)

    def heads(self) -> list[str]:
        """The winning token of each column, or its best one where a gap wins."""
        return [max((t for t in c if t != GAP), key=lambda t, c=c: (self.best(c[t]), [-ord(x) for x in t])) for c in self.columns]

    def consensus(self) -> list[str]:
        """The winning tokens; with equal votes a token wins over a gap, and the smaller token over a larger."""
        won = (max(c, key=lambda t, c=c: (self.best(c[t]), t != GAP, [-ord(x) for x in t])) for c in self.columns)
        return [t for t in won if t != GAP]

    def merged(self, other: Profile) -> Profile:
        """Both aligned to each other, with the votes of both."""
        columns = []
        for i, j in align(self.heads(), other.heads()):
            a = self.columns[i] if i is not None else {GAP: self.vote}
            b = other.columns[j] if j is not None else {GAP: other.vote}
            columns.append(a | {t: self.add(a[t], v) if t in a else v for t, v in b.items()})
        return Profile(columns, self.add(self.vote, other.vote), self.add, self.best)


class _First:
    """A priority as a number: the larger, the earlier."""

    def __init__(self, key: tuple) -> None:
        self.key = key

    def __lt__(self, other: _First) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _First) and self.key == other.key


def _votes(ranked: bool) -> tuple[Callable, Callable]:
    """How votes add, and what makes one the best: sums of weights (with equal sums the largest single weight), or the first of priorities."""
    return (min, _First) if ranked else (lambda x, y: (x[0] + y[0], max(x[1], y[1])), lambda x: x)


def _dump(p: Profile) -> str:
    return json.dumps([[[[t, v] for t, v in c.items()] for c in p.columns], p.vote])


def _load(text: str, ranked: bool) -> Profile:
    columns, vote = json.loads(text)
    return Profile([{t: tuple(v) for t, v in c} for c in columns], tuple(vote), *_votes(ranked))


def profile(values: Sequence[list[str]], votes: Sequence[object], ranked: bool = False) -> Profile:
    """The profile of values in the given order."""
    add, best = _votes(ranked)
    whole = Profile.of(values[0], votes[0], add, best)
    for row, vote in zip(values[1:], votes[1:], strict=True):
        whole = whole.merged(Profile.of(row, vote, add, best))
    return whole


def distance(consensus: Sequence[str], row: Sequence[str]) -> int:
    """Tokens to change, to add and to leave out."""
    return sum(i is None or j is None or consensus[i] != row[j] for i, j in align(consensus, row))


def representative(values: Sequence[list[str]], weights: Sequence[float]) -> int:
    """Index of the value closest to the weighted consensus of all; ties go to the larger weight, then to the earlier value."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], i))
    winner = profile([values[i] for i in order], [(weights[i], weights[i]) for i in order]).consensus()
    return min(order, key=lambda i: (distance(winner, values[i]), -weights[i]))


def _key(pos: dict, id_: str) -> tuple:
    """A priority with the id, as nested numbers and strings that compare as in the order of columns: nulls are last."""
    return (*(0 if v is None else v for v in pos.values()), id_)


def _profiled(table: pa.Table, ranked: bool) -> pa.Table:
    rows = table.to_pylist()
    votes = [_key(r["pos"], r["id"]) if ranked else (r["weight"], r["weight"]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (votes[i] if ranked else -votes[i][0], rows[i]["value"]))
    whole = profile([tokens(rows[i]["value"]) for i in order], [votes[i] for i in order], ranked)
    return pa.table({"g": table.column("g")[:1], "c": table.column("c")[:1], "profile": pa.array([_dump(whole)])})


def _joined(table: pa.Table, ranked: bool) -> pa.Table:
    parts = [_load(t, ranked) for _, t in sorted(zip(table.column("c").to_pylist(), table.column("profile").to_pylist(), strict=True))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    return pa.table({"g": table.column("g")[:1], "c": table.column("up")[:1], "profile": pa.array([_dump(whole)])})


def _winner(batches, ranked: bool):
    for batch in batches:
        won = [_load(t, ranked).consensus() for t in batch.column("profile").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(won, pa.list_(pa.string()))], names=["g", "consensus"])


def _measured(batches):
    for batch in batches:
        far = [distance(c, tokens(v)) for c, v in zip(batch.column("consensus").to_pylist(), batch.column("value").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("id"), batch.column("value"), batch.column("weight"), pa.array(far, pa.int64()), batch.column("pos")], names=["g", "id", "value", "weight", "far", "pos"])


def consensus_representatives(df: DataFrame, group: str, id_col: str, value_col: str, weight: Column | None = None, priority: Sequence[Column] = ()) -> DataFrame:
    """``group, id, value, weight``: for each group the existing value closest to the token-level consensus.

    ``weight`` (default 1 a row) are votes; ``priority`` are columns whose order makes a value outweigh all later ones
    together (smaller first, nulls last; the id decides ties). Equal values of a group are joined, with the smallest id and the sum of weights,
    unless ``priority`` is given, where the first of them stands for all. Equally close values: the larger weight (the first by priority), then the smaller value.
    Rows with a null group, id or value take no part; a group of none gives no row. Weights that are null or not positive count as 0.
    ``weight`` of the result is that of the whole group.
    """
    ranked = bool(priority)
    w = F.coalesce((weight if weight is not None else F.lit(1.0)).cast("double"), F.lit(0.0))
    pos = F.struct(*(x for i, p in enumerate(priority) for x in (p.isNull().cast("int").alias(f"n{i}"), p.alias(f"p{i}")))) if ranked else F.struct(F.lit(0).alias("n0"))
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(value_col).alias("value"), F.greatest(w, F.lit(0.0)).alias("weight"), pos.alias("pos"))
    rows = rows.where("g is not null and id is not null and value is not null")
    merged = rows.groupBy("g", "value").agg(F.sum("weight").alias("weight"), F.min(F.struct("pos", "id")).alias("m")).select("g", "m.id", "value", "weight", "m.pos")
    values = cut(merged)
    sizes = values.groupBy("g").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"))
    sizes = cut(sizes.select("g", "mass", F.ceil(F.col("n") / F.lit(CHUNK)).alias("chunks")))
    spread = values.join(sizes, "g").withColumn("c", F.pmod(F.xxhash64("value"), F.col("chunks")).cast("bigint"))
    schema = spread.select("g", "c", F.lit("").alias("profile")).schema
    parts = spread.groupBy("g", "c").applyInArrow(lambda t: _profiled(t, ranked), schema)
    most = sizes.agg(F.max("chunks")).first()[0] or 1
    while most > 1:
        up = cut(parts).withColumn("up", F.floor(F.col("c") / F.lit(CHUNK)))
        parts = up.groupBy("g", "up").applyInArrow(lambda t: _joined(t, ranked), schema)
        most = -(-most // CHUNK)
    kind = schema["g"].dataType.simpleString()
    won = parts.mapInArrow(lambda it: _winner(it, ranked), f"g {kind}, consensus array<string>")
    near = won.join(sizes, "g").withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select("g", "c", "consensus", "mass")
    far = spread.select("g", "c", "id", "value", "weight", "pos").join(near, ["g", "c"])
    both = far.select("g", "id", "value", F.struct("weight", "mass").alias("weight"), "consensus", "pos")
    types = dict(both.dtypes)
    measured = both.mapInArrow(_measured, f"g {kind}, id {types['id']}, value {types['value']}, weight {types['weight']}, far bigint, pos {types['pos']}")
    order = F.struct("far", "pos", "id") if ranked else F.struct("far", -F.col("weight.weight"), "value", "id")
    best = measured.groupBy("g").agg(F.min_by(F.struct("id", "value", "weight.mass"), order).alias("b"))
    return best.select(F.col("g").alias(group), F.col("b.id").alias(id_col), F.col("b.value").alias(value_col), F.col("b.mass").alias("weight"))


def valid_date(col: Column, until: str = "2026-06-30") -> Column:
    """The real calendar day that a string names in any of the written forms, if it is not after ``until``; else null.

    Forms: ISO with or without time, year/month/day, day before month with dots, slashes, blanks or dashes, and the day, the
    name of the month (English) and the year in either order, also two-digit days.
    """
    s = F.trim(F.regexp_replace(col, r"[\s\x{00a0}]+", " "))
    s = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    forms = [
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ].*)?$", (1, 2, 3)),
        (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
        (r"^(\d{1,2})[-/. ]+(\d{1,2})[-/. ]+(\d{4})(?:[T ].*)?$", (3, 2, 1)),
    ]
    out = [_day(s, form, at) for form, at in forms]
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = F.array_position(F.array(*(F.lit(m) for m in months)), F.lower(F.substring(F.regexp_extract(s, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", 1), 1, 3)))
    for form, (y, d) in ((r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[-. ]+(?:of )?[a-z]{3,9}[-., ]+(\d{4})$", (2, 1)), (r"(?i)^[a-z]{3,9}[. ]+(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})$", (2, 1)), (r"(?i)^(\d{4})[-. ]+[a-z]{3,9}[-. ]+(\d{1,2})$", (1, 2))):
        iso = F.format_string("%s-%02d-%02d", F.regexp_extract(s, form, y), number.cast("int"), F.try_to_number(F.regexp_extract(s, form, d), F.lit("99")).cast("int"))
        out.append(F.when(s.rlike(form) & (number > 0), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")))
    day = F.coalesce(*out)
    return F.when(day <= F.lit(until).cast("date"), day)


def _day(s: Column, form: str, at: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(s, form, i) for i in at)
    iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(s.rlike(form), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def url_host(col: Column) -> Column:
    """The host of an address: lower case, without scheme, user, port, a leading ``www.`` and outer blanks; null if there is none."""
    s = F.lower(F.trim(F.regexp_replace(col, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")))
    host = F.regexp_extract(s, r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?+(?:[^/?#@\s]*@)?+([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", ""), F.lit(""))


def best_records(standards: DataFrame, trust: DataFrame) -> DataFrame:
    """``stem, text_id, url_id, date_id``: for each group of ids that are equal before a dot and four or more digits, the
    members that give the text, the address and the date; null where no member has a usable one.

    Dates and addresses are ranked values, so they are minima of (rank, ...) tuples; the text goes through the
    consensus with priorities: longest, then latest valid date, then smallest id.
    """
    stem = F.regexp_extract("id", r"(?s)^(.*)\.[0-9]{4,}$", 1)
    rows = standards.where(F.col("id").rlike(r"(?s)^.*\.[0-9]{4,}$")).select("id", stem.alias("stem"), "standard_text", "last_verified_date", "source_url").distinct()
    rows = rows.select("id", "stem", "standard_text", url_host(F.col("source_url")).alias("host"), valid_date(F.col("last_verified_date")).alias("day"))
    ranks = trust.where("host is not null and trust_rank is not null").groupBy(F.lower(F.trim("host")).alias("host")).agg(F.min("trust_rank").alias("trust"))
    rows = cut(rows.join(ranks, "host", "left"))
    age = -F.unix_date("day")
    fields = rows.groupBy("stem").agg(
        F.min("id").alias("first"),
        F.max("id").alias("other"),
        F.min(F.when(F.col("day").isNotNull(), F.struct(age.alias("age"), "id"))).alias("d"),
        F.min(F.when(F.col("trust").isNotNull(), F.struct("trust", F.col("day").isNull().alias("none"), age.alias("age"), "id"))).alias("u"),
    )
    groups = fields.where("first <> other").select("stem", F.col("d.id").alias("date_id"), F.col("u.id").alias("url_id"))
    text = F.regexp_replace("standard_text", r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")
    usable = rows.withColumn("body", text).where((F.length("body") >= 20) & ~F.col("body").rlike(r"(?:…|\.\.\.)$"))
    usable = usable.join(groups.select("stem"), "stem", "left_semi")
    texts = consensus_representatives(usable, "stem", "id", "body", priority=[-F.length("body"), age])
    return groups.join(texts.select("stem", F.col("id").alias("text_id")), "stem", "left").select("stem", "text_id", "url_id", "date_id")
