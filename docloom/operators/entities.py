"""Policy table ETL: quality filter, merging of similar policies, umbrellas and best parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.simjoin import candidates, contained_candidates, first_per, greedy_leaders, jaccard_able, larger_able, rare_index
from docloom.staging import stage

# Title words.
GENERIC_TITLES = ["policy", "section", "criteria", "requirement", "guideline", "untitled", "unnamed", "additional", "other", "general"]
UMBRELLA_WORDS = ["criteria", "requirements", "eligibility", "medically necessary", "coverage"]
REFINER_UMBRELLA_WORDS = ["criteria", "requirements", "eligibility", "guidelines", "medically necessary", "coverage", "indications", "considerations"]
REFINER_TITLE_STOP = ["the", "a", "an", "and", "or", "for", "of", "in", "on", "at", "to"]
DOMAIN_WORDS = ["bariatric", "surgery", "adolescent", "criteria", "bmi", "obesity"]

# What a parent is chosen by, beside the page.
SIGNALS = ["words", "title_words", "conditions"]
PAGE_WEIGHT = 0.15

# Tables of classes with more rows are never broadcast to policies.
BROADCAST_ROWS = 20_000


def condition_counts(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n_conditions"))


def quality_filter(policies: DataFrame, counts: DataFrame) -> DataFrame:
    """Policies with a description of 20 characters, conditions if a nested leaf, confidence of 0.4 and no empty generic title; of equal descriptions the first."""
    parents = policies.where("parent_id is not null").select("job_id", F.col("parent_id").alias("policy_id")).distinct().withColumn("has_children", F.lit(True))
    rows = policies.join(counts, "policy_id", "left").join(parents, ["job_id", "policy_id"], "left")
    n = F.coalesce("n_conditions", F.lit(0))
    nested_leaf = F.col("has_children").isNull() & F.col("parent_id").isNotNull()
    title = F.lower("title")
    kept = rows.where(
        (F.length(X.stripped(F.col("description"))) >= 20)
        & ~(nested_leaf & (n == 0))
        & (F.col("confidence") >= 0.4)
        & ~(X.any_of(title, GENERIC_TITLES) & (F.length("title") < 25) & (n < 2))
    )
    return first_per(kept.withColumn("__desc", F.trim(F.lower(F.left("description", F.lit(100))))), ["job_id", "__desc"], [F.col("ord")]).drop("__desc", "has_children")


def similar_titles(titles: DataFrame) -> DataFrame:
    """(g, a, b) with a < b: semantically similar ones of ``titles(g, id, p)``, p from ``title_parts``, all texts of a group different.

    Each of the three signals has its own candidates by rare words, phrases or roots; only ids are joined until then.
    """

    def sets(field: str) -> DataFrame:
        rows = titles.where(F.size("p.words") > 0).select("g", "id", F.col(f"p.{field}").alias("t"))
        return stage(rows.withColumn("n", F.size("t")), "title-sets")

    met = (
        candidates(rare_index(sets("words"), 0.60), jaccard_able(0.60))
        .union(candidates(rare_index(sets("phrases"), 0.65), larger_able(0.65)))
        .union(contained_candidates(sets("roots"), 0.70))
        .distinct()
    )
    a, b = (titles.select("g", F.col("id").alias(i), F.col("p").alias(f"p{i}")) for i in "ab")
    return met.join(a, ["g", "a"]).join(b, ["g", "b"]).where(X.parts_semantically_similar(F.col("pa"), F.col("pb"))).select("g", "a", "b")


def overlapping_titles(titles: DataFrame) -> DataFrame:
    """(g, a, b) with a < b: ``titles(g, id, t, n)``, different word sets, that share over 0.7 of the smaller one."""
    met = contained_candidates(titles, 0.70)
    a, b = (titles.select("g", F.col("id").alias(i), F.col("t").alias(f"t{i}"), F.col("n").alias(f"n{i}")) for i in "ab")
    return met.join(a, ["g", "a"]).join(b, ["g", "b"]).where(F.size(F.array_intersect("ta", "tb")) / F.least("na", "nb") > 0.70).select("g", "a", "b")


def _few_or_merged(table: DataFrame) -> DataFrame:
    """A staged table to be joined to policies: one of many rows is merged, as Spark would broadcast it by the size of its compressed file."""
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


def _led(policies: DataFrame, group: Column, key: Column, similar) -> DataFrame:
    """``policies`` with their ``leader``: rows of one ``key`` share that of the first of them; ``similar`` gives the pairs of classes ``(g, k, id)``."""
    rows = policies.withColumns({"__g": group, "__k": key})
    classes = stage(rows.groupBy(F.col("__g").alias("g"), F.col("__k").alias("k")).agg(F.min("ord").alias("id")), "classes")
    lead = greedy_leaders(classes.select("g", F.col("id").alias("o")), similar(classes), "g", "o").withColumnRenamed("o", "id")
    led = stage(classes.join(lead, ["g", "id"]).select(F.col("g").alias("__g"), F.col("k").alias("__k"), "leader"), "class-leaders")
    return rows.join(_few_or_merged(led), ["__g", "__k"]).drop("__g", "__k")


def title_leaders(policies: DataFrame) -> DataFrame:
    """``policies`` with the ``leader`` of the first merging pass: greedy by semantic similarity of titles, all parents."""
    own = F.when(F.col("title").isNull(), F.col("ord"))  # no title is like no other

    def similar(classes: DataFrame) -> DataFrame:
        return similar_titles(stage(classes.select("g", "id", X.title_parts(F.col("k.text")).alias("p")), "title-parts"))

    return _led(policies, F.col("job_id"), F.struct(F.lower(F.trim("title")).alias("text"), own.alias("own")), similar)


def family_leaders(policies: DataFrame) -> DataFrame:
    """``policies`` with the ``leader`` of the second pass: greedy by overlap of titles within a parent and level."""
    family = F.concat_ws("|", F.col("job_id").cast("string"), F.coalesce(F.col("parent_id").cast("string"), F.lit("-")), F.col("level").cast("string"))
    words = F.array_sort(F.array_distinct(X.space_words(F.lower(F.coalesce("title", F.lit(""))))))
    own = F.when(F.size(words) == 0, F.col("ord").cast("string"))  # a title without words is like no other

    def similar(classes: DataFrame) -> DataFrame:
        return overlapping_titles(stage(classes.select("g", "id", F.col("k.t").alias("t"), F.size("k.t").alias("n")).where("n > 0"), "family-sets"))

    return _led(policies, family, F.struct(words.alias("t"), own.alias("own")), similar)


def merged_groups(members: DataFrame) -> DataFrame:
    """One row per ``leader``: the first policy with the longest description and the mean confidence; ``n_merged`` counts all that went into it."""
    merged = F.col("n_merged") if "n_merged" in members.columns else F.lit(1).cast("long")
    first = [F.min_by(c, "ord").alias(c) for c in ("policy_id", "parent_id", "level", "title")]
    return members.groupBy("job_id", F.col("leader").alias("ord")).agg(
        *first, F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"), F.avg("confidence").alias("confidence"), F.sum(merged).alias("n_merged")
    )


def merge_similar(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both merging passes: the merged policies, and all with their ``leader``: ``policies(job_id, ord, policy_id, parent_id, level, title, description, confidence)``.

    Leaders are carried along: only classes and clusters are joined to the policies. These are dealt out, however few files they came from.
    """
    first = stage(title_leaders(policies).repartition("job_id", "ord"), "leaders")
    second = stage(family_leaders(stage(merged_groups(first), "merged")), "leaders")
    last = second.select("job_id", F.col("ord").alias("leader"), F.col("leader").alias("last"))
    members = first.join(_few_or_merged(last), ["job_id", "leader"]).drop("leader").withColumnRenamed("last", "leader")
    return merged_groups(second), members


def unique_details(rows: DataFrame, key: list, order: list[str]) -> DataFrame:
    """(job_id, ord, ...): of the ``rows(job_id, leader, ...)`` of a cluster with equal ``key`` the first by ``order``; a task keeps one of each before any is shuffled."""
    keys = {f"__k{i}": k for i, k in enumerate(key)}
    details = [c for c in rows.columns if c not in ("job_id", "leader", "ord")]
    first = F.min_by(F.struct(*details), F.struct(*order)).alias("__first")
    return rows.withColumns(keys).groupBy("job_id", "leader", *keys).agg(first).select("job_id", F.col("leader").alias("ord"), "__first.*")


def group_details(members: DataFrame, details: DataFrame, key: list) -> DataFrame:
    """(job_id, ord, ...): ``details`` of a cluster's policies (by policy_id), of equal ``key`` those of the first policy; ``members`` are policies with their ``leader``.

    Details are far more than policies: these are hashed, so details are moved once and never sorted.
    """
    held = members.select("job_id", "ord", "policy_id", "leader")
    rows = details.withColumnRenamed("ord", "detail_ord").join(held.hint("shuffle_hash"), "policy_id")
    return unique_details(rows, key, ["ord", "detail_ord"])


def umbrella_scores(policies: DataFrame, counts: DataFrame, first_page: Column) -> DataFrame:
    """Score of every root by title, description, conditions, children and place; umbrellas are those of at least 2."""
    parents = policies.where("parent_id is not null").select("job_id", F.col("parent_id").alias("policy_id")).distinct().withColumn("has_children", F.lit(True))
    early = F.when(F.col("has_children"), 2).otherwise(0) + F.when(first_page <= 3, 1).otherwise(0)
    return _umbrellas(policies.where("parent_id is null").join(parents, ["job_id", "policy_id"], "left"), counts, UMBRELLA_WORDS, early, 2)


def refined_umbrella_scores(policies: DataFrame, counts: DataFrame) -> DataFrame:
    """Score of every root by title, description and conditions; umbrellas are those of at least 4."""
    return _umbrellas(policies.where("parent_id is null"), counts, REFINER_UMBRELLA_WORDS, F.lit(0), 4)


def _umbrellas(roots: DataFrame, counts: DataFrame, words: list[str], more: Column, threshold: int) -> DataFrame:
    """(job_id, policy_id, ord, score, is_umbrella); where no root of a job reaches the threshold, its first three are umbrellas."""
    score = (
        F.when(X.any_of(F.lower("title"), words), 2).otherwise(0)
        + F.when(F.size(X.space_words(F.col("description"))) > 25, 1).otherwise(0)
        + F.when(F.coalesce("n_conditions", F.lit(0)) >= 3, 1).otherwise(0)
        + more
    )
    scored = stage(roots.join(counts, "policy_id", "left").select("job_id", "policy_id", "ord", score.alias("score")), "scores")
    best = scored.groupBy("job_id").agg(F.max("score").alias("best"))
    lacking = scored.join(best.where(F.col("best") < threshold), "job_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("score"), "ord"))
    top = lacking.withColumn("nth", nth).where("nth <= 3").select("job_id", "policy_id", F.lit(True).alias("top"))
    return scored.join(top, ["job_id", "policy_id"], "left").select("job_id", "policy_id", "ord", "score", ((F.col("score") >= threshold) | F.coalesce("top", F.lit(False))).alias("is_umbrella"))


def with_keywords(policies: DataFrame, conditions: DataFrame, page: Column, of=X.keywords) -> DataFrame:
    """What parents are chosen by: keywords of text and conditions, words of the title, page (null where unknown)."""
    texts = conditions.groupBy("policy_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(of(F.col("description")))))).alias("conditions"))
    none = F.array().cast("array<string>")
    return policies.join(texts, "policy_id", "left").select(
        "job_id", "policy_id", "ord", F.array_distinct(of(F.concat_ws(" ", "title", "description"))).alias("words"), F.array_distinct(X.space_words(F.lower("title"))).alias("title_words"), F.coalesce("conditions", none).alias("conditions"), page.alias("page")
    )


def _share(a: Column, b: Column, of: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / of).otherwise(0.0)


def parent_parts() -> dict[str, Column]:
    """The four signals of extraction, by name: share of the child's keywords, place (nothing where unknown), share of the longer title, share of the child's condition keywords."""
    words, u_words, held, u_held = (F.col(c) for c in ("words", "u_words", "conditions", "u_conditions"))
    domain = F.size(F.array_intersect(F.array_intersect(words, u_words), F.array(*map(F.lit, DOMAIN_WORDS)))) > 0
    overlap = _share(words, u_words, F.size(words)) * F.when(domain, 1.2).otherwise(1.0)
    return {
        "keyword_overlap": overlap,
        "page_proximity": F.coalesce(1 / (1 + F.abs(F.col("page") - F.col("u_page"))), F.lit(0.0)),
        "title_pattern": F.size(F.array_intersect("title_words", "u_title_words")) / F.greatest(F.size("title_words"), F.size("u_title_words"), F.lit(1)),
        "condition_keywords": _share(held, u_held, F.size(held)),
    }


def refined_parts() -> dict[str, Column]:
    """The four signals of refinement, by name: Jaccard of keywords, place (a half where unknown), share of the umbrella's title words, Jaccard of condition keywords."""
    stop = F.array(*map(F.lit, REFINER_TITLE_STOP))
    theirs = F.array_except("u_title_words", stop)
    return {
        "keyword_overlap": X.jaccard(F.col("words"), F.col("u_words")),
        "page_proximity": F.coalesce(1 / (1 + F.abs(F.col("page") - F.col("u_page"))), F.lit(0.5)),
        "title_pattern": _share(F.array_except("title_words", stop), theirs, F.size(theirs)),
        "condition_keywords": X.jaccard(F.col("conditions"), F.col("u_conditions")),
    }


def weighted(parts: dict[str, Column]) -> Column:
    return 0.5 * parts["keyword_overlap"] + PAGE_WEIGHT * parts["page_proximity"] + 0.2 * parts["title_pattern"] + 0.15 * parts["condition_keywords"]


def parent_score() -> Column:
    """The weighted signals of extraction, of a child against an umbrella (``u_``); the score must be above 0.20."""
    return weighted(parent_parts())


def refined_score() -> Column:
    """The weighted signals of refinement; the score must be 0.35 at least."""
    return weighted(refined_parts())


def parent_pairs(children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """Children with the umbrellas (``u_``) of their job that they share a word of text, title or conditions with.

    Others have their place only, at most 0.15, and can't pass. Ids are joined by word first, the words come after.
    """
    own = ["job_id", "policy_id"]
    keys = F.array_distinct(F.concat("words", "title_words", "conditions")).alias("k")
    a = children.select(*own, F.explode(keys).alias("k"))
    b = umbrellas.select("job_id", F.col("policy_id").alias("u_policy_id"), F.explode(keys).alias("k"))
    met = stage(a.join(b, ["job_id", "k"]).where("policy_id <> u_policy_id").select(*own, "u_policy_id").distinct(), "parent-pairs")
    up = umbrellas.select("job_id", *[F.col(c).alias(f"u_{c}") for c in ("policy_id", "ord", "words", "title_words", "conditions", "page")])
    return met.join(children, own).join(up, ["job_id", "u_policy_id"])


def likely_pairs(indexed: DataFrame, others: DataFrame, weights: dict[str, Column], apart: float, same_page: float) -> DataFrame:
    """(job_id, i, o): policies of both tables that can reach a threshold together; pairs that can't are never formed.

    Rows of one policy_id have the same words, on several pages. weights: for each signal, what one shared word of it can add
    at most, by the sizes of the indexed side. A pair on different or unknown pages needs more than ``apart`` from shared
    words, one on the same page more than ``same_page``. Of an indexed policy's words that the others hold at all, the most
    frequent ones whose weights don't reach that together aren't keys: a pair that shares only those can't pass. So a word
    that all policies hold is a key only where it alone is enough.
    """

    def tokens(rows: DataFrame, name: str) -> DataFrame:
        def keys(signal: str) -> Column:
            return F.transform(F.array_distinct(signal), lambda w: F.concat(F.lit(f"{signal}:"), w))

        listed = F.flatten(F.array(*map(keys, weights)))
        of = [F.when(F.startswith("k", F.lit(f"{signal}:")), F.col(f"weight_{signal}")) for signal in weights]
        named = rows.dropDuplicates(["job_id", "policy_id"]).select("job_id", F.col("policy_id").alias(name), *[w.alias(f"weight_{signal}") for signal, w in weights.items()], F.explode(listed).alias("k"))
        return named.select("job_id", name, "k", F.coalesce(*of).alias("weight"))

    def pages(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("page is not null").select("job_id", F.col("policy_id").alias(name), "page").distinct()

    held = stage(tokens(others, "o").drop("weight"), "parent-words")
    frequency = held.groupBy("job_id", "k").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("job_id", "i").orderBy(F.desc("n"), "k").rowsBetween(Window.unboundedPreceding, 0)
    reach = tokens(indexed, "i").join(frequency, ["job_id", "k"]).withColumn("reach", F.sum("weight").over(order))
    prefix = stage(reach.where(F.col("reach") > min(apart, same_page) - 1e-6).select("job_id", "i", "k", (F.col("reach") > apart - 1e-6).alias("alone")), "parent-prefixes")
    plain = prefix.where("alone").join(held, ["job_id", "k"])
    near = prefix.where("not alone").join(pages(indexed, "i"), ["job_id", "i"]).join(held.join(pages(others, "o"), ["job_id", "o"]), ["job_id", "k", "page"])
    return stage(plain.select("job_id", "i", "o").union(near.select("job_id", "i", "o")).distinct(), "likely-pairs")


def with_both(pairs: DataFrame, children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """``pairs(job_id, policy_id, u_policy_id)`` with the words of the child and those of the umbrella (``u_``)."""
    up = umbrellas.select("job_id", *[F.col(c).alias(f"u_{c}") for c in ("policy_id", "ord", "words", "title_words", "conditions", "page")])
    return pairs.join(children, ["job_id", "policy_id"]).join(up, ["job_id", "u_policy_id"])


def extraction_likely(children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """(job_id, policy_id, u_policy_id) that can pass 0.20 in extraction: a neighbour's place is worth 0.075, the same page 0.15, so 0.125 or 0.05 must come from words."""

    def each(signal: str, weight: Column) -> Column:
        return F.when(F.size(signal) > 0, weight / F.size(signal)).otherwise(0.0)

    boosted = F.when(F.size(F.array_intersect("words", F.array(*map(F.lit, DOMAIN_WORDS)))) > 0, 0.6).otherwise(0.5)
    weights = {"words": each("words", boosted), "title_words": each("title_words", F.lit(0.2)), "conditions": each("conditions", F.lit(0.15))}
    found = likely_pairs(children, umbrellas, weights, 0.125, 0.05)
    return found.select("job_id", F.col("i").alias("policy_id"), F.col("o").alias("u_policy_id"))


def refinement_likely(children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """(job_id, policy_id, u_policy_id) that can reach 0.35 in refinement. Shares are bounded by the umbrella's sizes, so its words are indexed; a neighbour's or an unknown place is worth 0.075."""
    stop = F.array(*map(F.lit, REFINER_TITLE_STOP))
    short = [rows.withColumn("title_words", F.array_except("title_words", stop)) for rows in (umbrellas, children)]
    weights = {signal: F.when(F.size(signal) > 0, F.lit(w) / F.size(signal)).otherwise(0.0) for signal, w in (("words", 0.5), ("title_words", 0.2), ("conditions", 0.15))}
    found = likely_pairs(*short, weights, 0.275, 0.20)
    return found.select("job_id", F.col("o").alias("policy_id"), F.col("i").alias("u_policy_id"))


def extraction_pairs(children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """All pairs that can pass in extraction, with the words of both."""
    return with_both(extraction_likely(children, umbrellas), children, umbrellas)


def refinement_pairs(children: DataFrame, umbrellas: DataFrame) -> DataFrame:
    """All pairs that can pass in refinement, with the words of both."""
    return with_both(refinement_likely(children, umbrellas), children, umbrellas)


def best_parents(pairs: DataFrame, score: Column, enough) -> DataFrame:
    """(job_id, policy_id, parent_id, score): the best umbrella for each child of ``pairs`` for which ``enough`` holds, the first on ties."""
    scored = pairs.withColumn("score", F.round(score, 9)).where(enough(F.col("score")))
    return scored.groupBy("job_id", "policy_id").agg(F.max_by("u_policy_id", F.struct("score", -F.col("u_ord"))).alias("parent_id"), F.max("score").alias("score"))


def parents_by_text(children: DataFrame, umbrellas: DataFrame, likely, parts: dict[str, Column], enough) -> DataFrame:
    """What ``best_parents`` gives over all pairs, without forming them: policies with the same words are one text.

    Pairs are of texts, found by ``likely``, and their words are compared once. Only then come the pages: on a child's page
    the first of the nearest umbrellas stands for all of its text. An umbrella's text that is worse than a child's best one
    by more than a page is worth gets no pages. Scores are rounded to nine places, so what is nearer by less than that ties.
    """
    key = F.struct(*[F.array_sort(s).alias(s) for s in SIGNALS]).alias("t")
    place = F.struct("page").alias("place")  # an unknown page is a place of its own
    sides = [rows.select("job_id", "policy_id", "ord", "page", key, F.lit(up).alias("up")) for rows, up in ((children, False), (umbrellas, True))]
    rows = sides[0].union(sides[1])
    texts = stage(rows.select("job_id", "t").distinct().withColumn("text", F.monotonically_increasing_id()), "texts")
    placed = stage(rows.join(texts.hint("merge"), ["job_id", "t"]).select("job_id", "policy_id", "ord", "text", place, "up"), "placed")
    asking = stage(placed.where("not up").select("job_id", "text", "place").distinct(), "asking")
    offers = stage(placed.where("up").groupBy("job_id", F.col("text").alias("u_text"), F.col("place").alias("u_place")).agg(F.max(F.struct((-F.col("ord")).alias("turn"), "policy_id")).alias("first")), "offers")

    words = texts.select("job_id", "text", "t.*")
    u_words = texts.select("job_id", F.col("text").alias("u_text"), *[F.col(f"t.{s}").alias(f"u_{s}") for s in SIGNALS])
    found = likely(
        *[side.select("job_id", "text", page.alias("page")).join(words.hint("merge"), ["job_id", "text"]).withColumnRenamed("text", "policy_id") for side, page in ((asking, F.col("place.page")), (offers.withColumnRenamed("u_text", "text"), F.col("u_place.page")))]
    ).select("job_id", F.col("policy_id").alias("text"), F.col("u_policy_id").alias("u_text"))
    of_text = {name: part for name, part in parts.items() if name != "page_proximity"}
    both = found.join(words.hint("merge"), ["job_id", "text"]).join(u_words.hint("merge"), ["job_id", "u_text"])
    compared = stage(both.select("job_id", "text", "u_text", *[part.alias(name) for name, part in of_text.items()]), "compared")
    named = {name: F.col(name) for name in parts}
    rest = weighted(named | {"page_proximity": F.lit(0.0)})
    most = compared.groupBy("job_id", "text").agg(F.max(rest).alias("most"))
    able = stage(compared.join(most.hint("merge"), ["job_id", "text"]).where(rest >= F.col("most") - PAGE_WEIGHT - 1e-6).drop("most"), "able")

    met = able.join(asking.hint("merge"), ["job_id", "text"])
    pages = met.select("job_id", "u_text", "place").distinct().join(offers.hint("merge"), ["job_id", "u_text"]).select("job_id", "u_text", "place", "first", F.col("place.page").alias("page"), F.col("u_place.page").alias("u_page"))
    firsts = stage(pages.groupBy("job_id", "u_text", "place", parts["page_proximity"].alias("page_proximity")).agg(F.max("first").alias("first")), "firsts")
    nearest = firsts.groupBy("job_id", "u_text", "place").agg(F.max("page_proximity").alias("nearest"))
    near = stage(firsts.join(nearest.hint("merge"), ["job_id", "u_text", "place"]).where(F.col("page_proximity") >= F.col("nearest") - 1e-8).drop("nearest"), "nearest")

    score = F.round(weighted(named), 9)
    scored = met.join(near.hint("merge"), ["job_id", "u_text", "place"]).select("job_id", "text", "place", score.alias("score"), "first").where(enough(F.col("score")))
    best = scored.groupBy("job_id", "text", "place").agg(F.max(F.struct("score", "first.turn", F.col("first.policy_id").alias("u_policy_id"))).alias("best"))
    led = placed.where("not up").join(best.hint("merge"), ["job_id", "text", "place"]).select("job_id", "policy_id", "best.score", "best.u_policy_id", (-F.col("best.turn")).alias("u_ord"))
    return best_parents(led, F.col("score"), enough)


def roots_with_conditions(policies: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roots of ``policies`` and their conditions, a staged table: only roots choose parents and are chosen, so no other text is looked into.

    Conditions are far more than policies: these are hashed, so conditions are moved once and never sorted.
    """
    roots = policies.where("parent_id is null")
    held = conditions.select("policy_id", "description").join(roots.select("policy_id").hint("shuffle_hash"), "policy_id", "left_semi")
    return roots, stage(held, "root-conditions")


def extracted_parents(policies: DataFrame, conditions: DataFrame, page: Column) -> DataFrame:
    """Best parents of the roots that are no umbrellas, as extraction chooses them."""
    roots, held = roots_with_conditions(policies, conditions)
    scores = umbrella_scores(policies, condition_counts(held), page).select("job_id", "policy_id", "is_umbrella")
    rows = stage(with_keywords(roots, held, page).join(scores, ["job_id", "policy_id"]), "roots")
    return parents_by_text(rows.where("not is_umbrella"), rows.where("is_umbrella"), extraction_likely, parent_parts(), lambda s: s > 0.20)


def refined_roots(policies: DataFrame, conditions: DataFrame, page: Column) -> tuple[DataFrame, DataFrame]:
    """(children, umbrellas) of refinement with what parents are chosen by."""
    roots, held = roots_with_conditions(policies, conditions)
    scores = refined_umbrella_scores(roots, condition_counts(held)).select("job_id", "policy_id", "is_umbrella")
    rows = stage(with_keywords(roots, held, page, X.refiner_keywords).join(scores, ["job_id", "policy_id"]), "roots")
    return rows.where("not is_umbrella"), rows.where("is_umbrella")


def refined_pairs(policies: DataFrame, conditions: DataFrame, page: Column) -> DataFrame:
    """All pairs that share a word, for a report of their signals."""
    return parent_pairs(*refined_roots(policies, conditions, page))


def refined_parents(policies: DataFrame, conditions: DataFrame, page: Column) -> DataFrame:
    """Best parents of the roots that are no umbrellas, as refinement chooses them."""
    return parents_by_text(*refined_roots(policies, conditions, page), refinement_likely, refined_parts(), lambda s: s >= 0.35)


def last_definitions(definitions: DataFrame) -> DataFrame:
    """Of each term the definition of the last chunk."""
    return definitions.groupBy("job_id", "term").agg(F.max_by("definition", "chunk_ord").alias("definition"))


def typed_policies(responses: DataFrame) -> DataFrame:
    """Policies of JSON responses ``(response_id, content)`` with defaults; what doesn't parse gives no rows."""
    schema = "struct<policies:array<struct<policy_id:string,title:string,description:string,level:int,confidence:double>>>"
    parsed = F.variant_get(X.json_value(F.col("content")), "$", schema)
    rows = responses.select("response_id", F.posexplode(parsed["policies"]).alias("pos", "p"))
    return rows.select(
        "response_id", "pos", "p.policy_id", F.coalesce("p.title", F.lit("Untitled Policy")).alias("title"), F.left("p.description", F.lit(500)).alias("description"), F.coalesce("p.level", F.lit(0)).alias("level"), F.coalesce("p.confidence", F.lit(0.7)).alias("confidence")
    )


def extraction_summary(responses: DataFrame) -> DataFrame:
    """(job_id, chunks, failed, policies): of ``responses(job_id, response_id, content)``, a chunk each; null or broken content has failed and is skipped."""
    ok = responses.withColumn("ok", F.coalesce(X.json_value(F.col("content")).isNotNull(), F.lit(False)))
    counts = ok.groupBy("job_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~F.col("ok")).alias("failed"))
    made = typed_policies(responses).join(responses.select("response_id", "job_id"), "response_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("policies"))
    return counts.join(made, "job_id", "left").withColumn("policies", F.coalesce("policies", F.lit(0)))
