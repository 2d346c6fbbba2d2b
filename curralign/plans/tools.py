"""The six read-only tools, each for many inputs at once; one input is a frame with one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import allowed, grade_rank, within, written_bounds
from ..functions.notes import reason, strength
from ..functions.text import expand_id, loose_id, stripped_id
from ..operators import fts
from ..operators.graph import HARD, learning_path, prefer_validated, prerequisites
from ..operators.ranking import ranked, top_per_group
from ..operators.vectors import cosine_to, cosine_top_k, similarity_join
from .crosswalk import best_any, hub_reverse, precomputed, two_hop

PROGRESSION_FLOOR, PROGRESSION_K = 0.5, 3
FALLBACK_FLOOR, FALLBACK_K = 0.35, 3
#: Elements of a block of searches: 16,384 vectors of 64.
SEARCH_NUMBERS = 1_048_576


def scoped(standards: DataFrame, hubs: dict[str, str], system: str | None = None, subject: str | None = None) -> DataFrame:
    """The standards a search covers: a system, else the hub of a subject, else a subject without hub, else all hubs."""
    if system:
        return standards.where(F.col("system") == system)
    if subject:
        return standards.where(F.col("system") == hubs[subject]) if subject in hubs else standards.where(F.col("subject") == subject)
    return standards.where(F.col("system").isin(*sorted(set(hubs.values()))))


def filtered(standards: DataFrame, grade: object = None, domain: str | None = None) -> DataFrame:
    """Grades by list, range or code, and a domain by a part of its name in any case."""
    if grade is not None:
        standards = standards.where(allowed(F.col("grade"), grade))
    return standards.where(F.lower("domain").contains(domain.lower())) if domain else standards


def search(standards: DataFrame, vectors: DataFrame, query: list[float], hubs: dict[str, str], system: str | None = None, subject: str | None = None, grade: object = None, domain: str | None = None, limit: int = 5) -> DataFrame:
    """search_standards by meaning: ``id, score`` and the fields shown, best first; ties by id descending."""
    rows = filtered(scoped(standards, hubs, system, subject), grade, domain).select("id", "system", "grade", "domain", "standard_text").distinct()
    top = cosine_top_k(vectors.join(rows.select("id"), "id", "left_semi"), query, limit)
    return top.join(rows, "id")


def search_text(standards: DataFrame, query: str, hubs: dict[str, str], system: str | None = None, subject: str | None = None, grade: object = None, domain: str | None = None, limit: int = 5, cap: int = fts.CAP) -> DataFrame:
    """search_standards by words: the best ``cap`` of all standards are ranked first and scoped afterwards, so fewer than ``limit`` may remain."""
    rows = standards.select("id", "system", "subject", "grade", "domain", "cluster", "standard_text").distinct()
    found = fts.bm25(fts.index(rows, "id", "standard_text", "domain", "cluster"), fts.query_terms(query), cap)
    inside = filtered(scoped(rows, hubs, system, subject), grade, domain)
    return found.join(inside.select("id", "system", "grade", "domain"), "id").orderBy(F.col("score").desc(), "id").limit(limit)


def _bounds(start: object, end: object) -> F.Column:
    return written_bounds(*(F.lit(None if x is None else str(x)).cast("string") for x in (start, end)))


def progression(standards: DataFrame, vectors: DataFrame, query: list[float], system: str, start: object = None, end: object = None) -> DataFrame:
    """get_progression: ``grade, grade_no, id, score``, up to three standards of each grade above the floor, grades in order."""
    rows = standards.where((F.col("system") == system) & within(F.col("grade"), _bounds(start, end))).select("id", "grade").distinct()
    scored = vectors.join(rows, "id").select("id", "grade", F.round(cosine_to(F.col("vec"), query), 4).alias("score")).where(F.col("score") >= PROGRESSION_FLOOR)
    return top_per_group(scored, ["grade"], [F.col("score").desc(), F.col("id").desc()], PROGRESSION_K).select("grade", grade_rank(F.col("grade")).alias("grade_no"), "id", "score")


def progression_text(standards: DataFrame, query: str, system: str, start: object = None, end: object = None, limit: int = 60) -> DataFrame:
    """get_progression by words: the first ``limit`` of the system, three of each grade within the normalised bounds."""
    rows = standards.select("id", "system", "grade", "domain", "cluster", "standard_text").distinct()
    found = fts.bm25(fts.index(rows, "id", "standard_text", "domain", "cluster"), fts.query_terms(query)).join(rows.where(F.col("system") == system).select("id", "grade"), "id")
    first = found.orderBy(F.col("score").desc(), "id").limit(limit)
    first = first.where(within(F.col("grade"), _bounds(start, end), unknown=False))
    return top_per_group(first, ["grade"], [F.col("score").desc(), F.col("id")], PROGRESSION_K).select("grade", "id", "score")


def search_many(rows: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """search_standards for a frame of inputs (``q, vec, scope``): ``q, id, score, rank_no``, the ``limit`` most similar standards
    (``id, vec, scope``) of each input's scope, equal scores by larger id. One blocked join answers all inputs."""
    left = asked.select(F.col("q").cast("string").alias("id"), "vec", F.lit(0).alias("rank"), "scope")
    right = rows.select("id", "vec", F.lit(0).alias("rank"), "scope")
    found = similarity_join(left, right, "scope", -1.0, (), None, limit, ties=-1, numbers=SEARCH_NUMBERS)
    best = ranked(found, ["a"], [F.col("cosine").desc(), F.col("b").desc()], "rank_no").where(F.col("rank_no") <= limit)
    return best.select(F.col("a").alias("q"), F.col("b").alias("id"), F.col("cosine").alias("score"), "rank_no")


def progression_many(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """get_progression for a frame of inputs (``q, vec, scope, start, end``): ``q, grade, id, score``, of each grade within an input's bounds
    the three most similar standards (``id, vec, scope, grade``) above the floor."""
    left = asked.select(F.col("q").cast("string").alias("id"), "vec", F.lit(0).alias("rank"), "scope", F.lit("").alias("grade"))
    right = rows.select("id", "vec", F.lit(0).alias("rank"), "scope", "grade")
    found = similarity_join(left, right, "scope", PROGRESSION_FLOOR, ("grade",), None).select(F.col("a").alias("q"), F.col("b_grade").alias("grade"), F.col("b").alias("id"), F.col("cosine").alias("score"))
    bounds = asked.select(F.col("q").cast("string").alias("q"), written_bounds(F.col("start"), F.col("end")).alias("bounds"))
    inside = found.join(bounds, "q").where(within(F.col("grade"), F.col("bounds"), unknown=False))
    return top_per_group(inside, ["q", "grade"], [F.col("score").desc(), F.col("id").desc()], PROGRESSION_K).select("q", "grade", "id", "score")


def search_text_many(standards: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """search_standards by words for a frame of inputs (``q, query, system``): ``q, id, score, rank_no``. Each input ranks the whole of
    its system, without the cap of the single form."""
    rows = standards.select("id", "system", "domain", "cluster", "standard_text").distinct()
    found = fts.bm25_many(fts.postings(rows, "id", "standard_text", "domain", "cluster"), asked.select("q", "query"))
    inside = found.join(rows.select("id", "system"), "id").join(asked.select("q", "system"), ["q", "system"])
    return ranked(inside, ["q"], [F.col("score").desc(), F.col("id")], "rank_no").where(F.col("rank_no") <= limit).select("q", "id", "score", "rank_no")


def resolve_ids(standards: DataFrame, inputs: DataFrame, system: str | None = None) -> DataFrame:
    """``input, id``: what each input names: exactly, in another letter case, without marks at its ends, or without a cluster letter;
    the earlier of these wins, then the smaller id. Inputs that name nothing give no row."""
    ids = standards.select("id", "system").distinct()
    if system:
        ids = ids.where(F.col("system") == system)
    raw, bare = F.col("input"), stripped_id(F.col("input"))
    forms = [("e", raw), ("u", F.upper(raw)), ("e", bare), ("u", F.upper(bare)), ("l", loose_id(raw)), ("l", loose_id(bare))]
    wanted = inputs.select("input", F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), F.lit(k).alias("kind"), c.alias("form")) for i, (k, c) in enumerate(forms)))).alias("w")).select("input", "w.*")
    keys = ids.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("form")) for k, c in (("e", F.col("id")), ("u", F.upper("id")), ("l", loose_id(F.col("id"))))))).alias("k")).select("id", "k.*")
    return wanted.join(keys, ["kind", "form"]).groupBy("input").agg(F.min(F.struct("tier", "id")).alias("m")).select("input", "m.id")


def suggestions(standards: DataFrame, inputs: DataFrame, system: str, limit: int = 5) -> DataFrame:
    """For inputs that name nothing, ids of the system with the same third segment; none for ids without one."""
    token = F.get(F.split("input", r"\."), F.lit(2))
    ids = standards.where(F.col("system") == system).select("id").distinct().withColumn("token", F.get(F.split("id", r"\."), F.lit(2)))
    return top_per_group(inputs.withColumn("token", token).join(ids, "token"), ["input"], [F.col("id")], limit).select("input", "id")


def lookup(standards: DataFrame, subs: DataFrame, edges: DataFrame, inputs: DataFrame, system: str = "ccss", validated: str = "llm_validated", prefer: bool = True) -> DataFrame:
    """lookup_standard: the standard of each input with its parts in order, its prerequisites and successors (validated ones if there are any), and why."""
    named = resolve_ids(standards, inputs.select(expand_id(F.col("input"), system).alias("input"), F.col("input").alias("asked")).select("input").distinct(), system if system != "ccss" else None)
    ids = named.select("id").distinct()
    parts = subs.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").distinct()
    parts = parts.groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("id"), "text"))), lambda x: x["text"]).alias("sub_standards"))
    mine = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").distinct()
    mine = prefer_validated(mine, validated) if prefer else mine
    score = F.when(F.isnan("confidence_score"), None).otherwise(F.col("confidence_score"))
    why = F.struct((-F.coalesce(score, F.lit(-1.0))).alias("o"), F.col("target_id").alias("id"), F.coalesce(strength(F.col("notes")), F.when(score >= HARD, "hard").when(score.isNotNull(), "soft")).alias("strength"), reason(F.col("notes")).alias("why"))
    near = mine.groupBy(F.col("source_id").alias("id")).agg(
        *(F.transform(F.array_sort(F.collect_set(F.when(F.col("relationship") == r, why))), lambda x: F.struct(x["id"].alias("id"), x["strength"].alias("strength"), x["why"].alias("why"))).alias(f"{r}s") for r in ("prerequisite", "successor"))
    )
    fields = standards.select("id", "system", "subject", "grade", "domain", "cluster", "standard_text").distinct()
    return named.join(fields, "id").join(parts, "id", "left").join(near, "id", "left")


def path(standards: DataFrame, edges: DataFrame, targets: DataFrame, starts: DataFrame | None = None, max_depth: int = 20, include_soft: bool = False) -> DataFrame:
    """get_learning_path: see :func:`curralign.operators.graph.learning_path`."""
    return learning_path(prerequisites(edges, include_soft), standards, targets, starts, max_depth)


def path_notes(paths: DataFrame) -> DataFrame:
    """``root, steps, note``: what to say of each path: a single step has no prerequisites."""
    n = paths.groupBy("root").agg(F.count("*").alias("steps"))
    return n.select("root", "steps", F.when(F.col("steps") == 1, "no prerequisites recorded").otherwise("ordered by grade").alias("note"))


def map_standards(crosswalks: DataFrame, vectors: DataFrame, standards: DataFrame, inputs: DataFrame, hub: str, threshold: float = 0.7, include_flagged: bool = False) -> DataFrame:
    """map_standard: ``source_id, to_system, strategy, target_id, score, rank_no`` for inputs (``source_id, to_system``).

    Strategy 1 (precomputed) ends the search of an input; else the best mapping below the threshold (2), the bridge over the hub
    (3) and the nearest by meaning (4) come out together, each with its rank; inputs without any have the strategy ``none``.
    """
    want = inputs.select("source_id", "to_system").distinct()

    def of(df: DataFrame, system: str) -> DataFrame:
        return df.withColumnRenamed(system, "to_system") if system != "to_system" else df

    cols = ["source_id", "to_system", "strategy", "target_id", "score", "rank_no"]
    one = of(precomputed(crosswalks, threshold, include_flagged), "target_system").join(want, ["source_id", "to_system"], "left_semi").select("source_id", "to_system", F.lit("precomputed").alias("strategy"), "target_id", F.col("confidence_score").alias("score"), "rank_no")
    rest = want.join(one.select("source_id", "to_system").distinct(), ["source_id", "to_system"], "left_anti")
    two = of(best_any(crosswalks), "target_system").join(rest, ["source_id", "to_system"], "left_semi").select("source_id", "to_system", F.lit("below_threshold").alias("strategy"), "target_id", F.col("confidence_score").alias("score"), F.lit(1).alias("rank_no"))
    over = two_hop(crosswalks, hub).unionByName(hub_reverse(crosswalks, hub)).join(rest, ["source_id", "to_system"], "left_semi")
    three = ranked(over, ["source_id", "to_system"], [F.col("confidence").desc(), F.col("target_id")], "rank_no").where("rank_no <= 5").select("source_id", "to_system", F.lit("two_hop").alias("strategy"), "target_id", F.col("confidence").alias("score"), "rank_no")
    four = nearest_in_system(vectors, standards, rest).select("source_id", "to_system", F.lit("nearest").alias("strategy"), "target_id", "score", "rank_no")
    found = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols)).unionByName(four.select(*cols))
    none = want.join(found.select("source_id", "to_system").distinct(), ["source_id", "to_system"], "left_anti").select("source_id", "to_system", F.lit("none").alias("strategy"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank_no"))
    return found.unionByName(none)


def nearest_in_system(vectors: DataFrame, standards: DataFrame, inputs: DataFrame, k: int = FALLBACK_K, floor: float = FALLBACK_FLOOR) -> DataFrame:
    """``source_id, to_system, target_id, score, rank_no``: of each input the ``k`` nearest standards of a system, above the floor."""
    systems = standards.select("id", "system").distinct()
    left = inputs.join(vectors.select(F.col("id").alias("source_id"), "vec"), "source_id").select(F.col("source_id").alias("id"), "vec", F.lit(0).alias("rank"), F.col("to_system").alias("scope"))
    right = vectors.join(systems, "id").select("id", "vec", F.lit(0).alias("rank"), F.col("system").alias("scope"))
    found = similarity_join(left.withColumn("to", F.col("scope")), right.withColumn("to", F.col("scope")), "scope", floor, ("to",), None, k, ties=-1)
    best = ranked(found, ["a", "a_to"], [F.col("cosine").desc(), F.col("b").desc()], "rank_no").where(F.col("rank_no") <= k)
    return best.select(F.col("a").alias("source_id"), F.col("a_to").alias("to_system"), F.col("b").alias("target_id"), F.col("cosine").alias("score"), "rank_no")


def list_systems(standards: DataFrame, crosswalks: DataFrame, meta: DataFrame | None = None, subject: str | None = None, region: str | None = None) -> DataFrame:
    """list_systems: ``system, subjects, standards, crosswalks`` and what is known of each; filters by subject and a part of the region's name."""
    s = standards.select("id", "system", "subject").distinct()
    by = s.groupBy("system").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"), F.count("*").alias("standards"))
    links = crosswalks.select("id", "source_system").distinct().groupBy(F.col("source_system").alias("system")).agg(F.count("*").alias("crosswalks"))
    out = by.join(links, "system", "left").withColumn("crosswalks", F.coalesce("crosswalks", F.lit(0)))
    if meta is not None:
        out = out.join(meta, "system", "left")
    if subject:
        out = out.where(F.array_contains(F.split("subjects", ","), subject))
    return out.where(F.lower("region").contains(region.lower())) if region and meta is not None else out


def totals(standards: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """``standards, systems, subjects, crosswalks``: the counts of the greeting, zero for empty tables."""
    a = standards.select("id", "system", "subject").distinct().agg(F.count("*").alias("standards"), F.countDistinct("system").alias("systems"), F.countDistinct("subject").alias("subjects"))
    return a.join(crosswalks.select("id").distinct().agg(F.count("*").alias("crosswalks")), F.lit(True))
