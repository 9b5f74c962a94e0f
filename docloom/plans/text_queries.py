"""Queries over pages and titles: scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.plans.registration import Registry

registry = Registry()
query = registry.query

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def stripped(column: str) -> str:
    return STRIP.format(column)


def word_list(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def kept(tokens: str, stop, longer: int = 0) -> str:
    return f"list_filter({tokens}, lambda w: w NOT IN ({quoted(stop)}) AND length(w) > {longer})"


PAGES = "SELECT *, count(*) OVER (PARTITION BY doc_id) AS pages FROM {text_pages}"
POLICY_HITS = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in X.IMPORTANCE_WORDS)
SCANNED = rf"(length({stripped('text')}) < 50 OR len(regexp_extract_all(text, '\S+')) < 10)"


@query(
    rf"""SELECT doc_id, page_number, greatest(1, length(text) // 4) AS approx_tokens, {stripped("substr(text, 1, 250)")} AS preview, {SCANNED} AS is_scanned,
    round(least(1.0, 0.5 + CASE WHEN CAST(page_number AS DOUBLE) / pages > 0.1 AND CAST(page_number AS DOUBLE) / pages < 0.9 THEN 0.1 ELSE 0 END + least(0.2, (page_number % 5) * 0.05) + least(0.1, (page_number % 3) * 0.03)
      + least(0.2, CAST(length(text) AS DOUBLE) / 5000) + least(0.1, ({POLICY_HITS}) * 0.02)), 6) AS importance,
    NOT ((page_number = 1 AND length({stripped("text")}) < 500) OR contains(lower(text), 'table of contents') OR (page_number > pages * 0.95 AND contains(substr(lower(text), 1, 200), 'index')) OR (length({stripped("text")}) < 100 AND regexp_matches({stripped("text")}, '^\d+$'))) AS has_policy_content,
    round(CASE WHEN length(text) > 0 THEN least(1.0, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) / CAST(length(text) AS DOUBLE) * CAST(1.2 AS DOUBLE)) ELSE 0 END, 6) AS ocr_confidence
    FROM ({PAGES}) q""",
    "text_pages",
)
def p01_p05_page_features(t):
    pages = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    t = t.withColumn("pages", pages)
    page, text = F.col("page_number"), F.col("text")
    return t.select(
        "doc_id",
        "page_number",
        X.approx_tokens(text).alias("approx_tokens"),
        X.preview(text).alias("preview"),
        X.is_scanned(text).alias("is_scanned"),
        F.round(X.page_importance(text, page, F.col("pages"), page % 5, page % 3, F.lit(0)), 6).alias("importance"),
        X.has_policy_content(text, page, F.col("pages")).alias("has_policy_content"),
        F.round(X.ocr_confidence(text), 6).alias("ocr_confidence"),
    )


LINES = r"SELECT doc_id, line_no, CASE line_no % 7 WHEN 1 THEN CAST(line_no AS VARCHAR(9)) || '. Title ' || line WHEN 2 THEN '1.2 ' || line WHEN 3 THEN '1.2.3 ' || line WHEN 4 THEN 'section ' || CAST(line_no AS VARCHAR(9)) || line WHEN 5 THEN upper(replace(line, 'ß', 'ss')) ELSE line END AS line FROM {doc_lines}"
LEVEL = r"CASE WHEN regexp_matches(l, '^\d+\.\s+[A-Z]') THEN 1 WHEN regexp_matches(l, '^\d+\.\d+\s+') THEN 2 WHEN regexp_matches(l, '^\d+\.\d+\.\d+\s+') THEN 3 WHEN regexp_matches(l, '(?i)^(Article|Section|Chapter)\s+\d+') THEN 1 END"


@query(
    rf"""WITH n AS ({LINES}), s AS (SELECT doc_id, line_no, {stripped("line")} AS l FROM n), v AS (SELECT *, {LEVEL} AS numbered, upper(l) = l AND lower(l) <> l AND length(l) > 5 AND length(l) < 100 AS caps FROM s WHERE length(l) >= 3)
    SELECT doc_id, line_no, l AS line, CAST(CASE WHEN caps AND coalesce(numbered, 3) = 3 THEN 2 ELSE numbered END AS INT) AS level FROM v WHERE caps OR numbered IS NOT NULL""",
    "doc_lines",
)
def p06_heading_extract(t):
    no = F.col("line_no").cast("string")
    made = (
        F.when(F.col("line_no") % 7 == 1, F.concat(no, F.lit(". Title "), "line"))
        .when(F.col("line_no") % 7 == 2, F.concat(F.lit("1.2 "), "line"))
        .when(F.col("line_no") % 7 == 3, F.concat(F.lit("1.2.3 "), "line"))
        .when(F.col("line_no") % 7 == 4, F.concat(F.lit("section "), no, "line"))
        .when(F.col("line_no") % 7 == 5, F.upper("line"))
        .otherwise(F.col("line"))
    )
    lines = t.select("doc_id", "line_no", X.stripped(made).alias("line"))
    return lines.withColumn("level", X.heading_level(F.col("line"))).where("level is not null")


DEFINES = r"regexp_matches(lower(text), '\bdefinition|\bdefined as\b|\bmeans\b|\brefers to\b|\bshall mean\b')"
ADMIN = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}' END" for name, words in X.ADMIN_FAMILIES.items())


@query(
    rf"""SELECT doc_id, page_number, {DEFINES} AS has_definitions, {DEFINES} OR NOT regexp_matches(lower(text), 'see section|refer to|as defined in|pursuant to') AS complete,
    len({kept(word_list("text"), X.SIMILARITY_STOP)}) AS n_tokens, array_to_string({kept(word_list("text"), X.KEYWORD_STOP, 3)}, ' ') AS keywords, len(list_distinct({kept(word_list("text"), X.REFINER_STOP, 3)})) AS n_refiner_keywords,
    len({word_list("text")}) AS n_words, array_to_string(list_filter([{ADMIN}], lambda x: x IS NOT NULL), ',') AS admin FROM {{text_pages}}""",
    "text_pages",
)
def p10_p14_p19_p25_page_words(t):
    text = F.col("text")
    return t.select(
        "doc_id",
        "page_number",
        X.contains_definitions(text).alias("has_definitions"),
        X.context_complete(text).alias("complete"),
        F.size(X.similarity_tokens(text)).alias("n_tokens"),
        F.array_join(X.keywords(text), " ").alias("keywords"),
        F.size(X.refiner_keywords(text)).alias("n_refiner_keywords"),
        F.size(X.words(text)).alias("n_words"),
        F.array_join(X.admin_sections(text), ",").alias("admin"),
    )


TITLES = "SELECT a.policy_id AS a_id, b.policy_id AS b_id, a.title AS a, b.title AS b, a.description AS ad, b.description AS bd FROM {policies} a JOIN {policies} b ON a.job_id = b.job_id AND a.ord + 1 = b.ord"


def set_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def neighbours(t):
    a = t.select("job_id", "ord", F.col("policy_id").alias("a_id"), F.col("title").alias("a"), F.col("description").alias("ad"))
    b = t.select("job_id", (F.col("ord") - 1).alias("ord"), F.col("policy_id").alias("b_id"), F.col("title").alias("b"), F.col("description").alias("bd"))
    return a.join(b, ["job_id", "ord"])


@query(
    f"""WITH p AS ({TITLES}), k AS (SELECT *, list_distinct({kept(word_list("ad"), X.VERIFIER_STOP)}) AS av, list_distinct({kept(word_list("bd"), X.VERIFIER_STOP)}) AS bv, list_distinct({word_list("ad")}) AS aw, list_distinct({word_list("bd")}) AS bw,
      list_distinct({kept(word_list("a"), X.SIMILARITY_STOP)}) AS a_t, list_distinct({kept(word_list("b"), X.SIMILARITY_STOP)}) AS b_t, list_distinct(string_split(lower(a), ' ')) AS asp, list_distinct(string_split(lower(b), ' ')) AS bsp FROM p),
    s AS (SELECT a_id, b_id, round({set_jaccard("av", "bv")}, 6) AS text_jaccard, round({set_jaccard("aw", "bw")}, 6) AS string_jaccard, round(CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1.0 ELSE {set_jaccard("a_t", "b_t")} END, 6) AS title_jaccard,
      CAST(len(list_intersect(asp, bsp)) AS DOUBLE) / least(len(asp), len(bsp)) > 0.7 AS titles_similar FROM k)
    SELECT *, CASE WHEN text_jaccard > 0.9 THEN 'MERGE' WHEN text_jaccard > 0.8 THEN 'REVIEW' ELSE 'MONITOR' END AS recommendation FROM s""",
    "policies",
)
def p17_p18_p32_p35_similarity(t):
    a, b, ad, bd = (F.col(c) for c in ("a", "b", "ad", "bd"))
    scored = neighbours(t).select(
        "a_id",
        "b_id",
        F.round(X.text_jaccard(ad, bd), 6).alias("text_jaccard"),
        F.round(X.jaccard(X.words(ad), X.words(bd)), 6).alias("string_jaccard"),
        F.round(X.title_jaccard(a, b), 6).alias("title_jaccard"),
        X.titles_similar(a, b).alias("titles_similar"),
    )
    return scored.withColumn("recommendation", X.merge_recommendation(F.col("text_jaccard")))


def root_sql(word: str) -> str:
    tests = " ".join(f"WHEN {word} LIKE '%{s}' AND length({word}) > {len(s) + 2} THEN left({word}, length({word}) - {len(s)})" for s in sorted(X.SUFFIXES, key=len, reverse=True))
    return f"CASE {tests} ELSE {word} END"


@query(f"WITH w AS (SELECT DISTINCT unnest({word_list('text')}) AS word FROM {{documents}}) SELECT word, {root_sql('word')} AS root FROM w", "documents")
def p16_root_word(t):
    return t.select(F.explode(X.words(F.col("text"))).alias("word")).distinct().select("word", X.root_word(F.col("word")).alias("root"))


@query(
    r"""WITH w AS (SELECT policy_id, string_split(lower(title), ' ') AS w FROM {policies}), g AS (SELECT policy_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS two, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS three FROM w)
    SELECT policy_id, array_to_string(list_sort(list_distinct(list_concat(two, three))), '|') AS phrases FROM g""",
    "policies",
)
def p15_key_phrases(t):
    return t.select("policy_id", F.array_join(F.array_sort(X.key_phrases(F.lower("title"))), "|").alias("phrases"))


SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace('Section ' || description, '(?i)^(Section|Chapter|Part|Article)\s+', '')), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    rf"""WITH s AS (SELECT policy_id, title, description, {SLUG} AS slug, parent_id IS NOT NULL AS nested FROM {{policies}}), c AS (SELECT *, CASE WHEN length(slug) > 50 THEN array_to_string(list_slice(string_split(slug, '_'), 1, 5), '_') ELSE slug END AS cut FROM s)
    SELECT policy_id, CASE WHEN nested THEN 'top_level_' || cut ELSE cut END AS section_id, regexp_matches(title, '^\d+\.\s+[A-Z]|^[A-Z\s]{{3,}}$|^\d+\.\d+\s+[A-Z]|^POLICY\s*:|^COVERAGE\s*:') OR {" OR ".join(f"contains(lower(title), '{w}')" for w in X.POLICY_WORDS)} AS is_policy FROM c""",
    "policies",
)
def p20_p21_section_slug(t):
    parent = F.when(F.col("parent_id").isNotNull(), F.lit("top_level_section"))
    title = F.concat(F.lit("Section "), F.col("description"))
    return t.select("policy_id", X.section_slug(title, parent).alias("section_id"), X.is_policy_heading(F.col("title")).alias("is_policy"))


@query(
    """SELECT doc_id, page_number, round(CASE WHEN primary_type IN ('table_of_contents', 'index', 'bibliography', 'administrative') THEN 0.9 ELSE 1.0 - chunk_priority END, 6) AS filterable,
    round(least(1.0, CASE WHEN primary_type = 'policy_content' THEN 0.9 WHEN primary_type IN ('definitions', 'coverage') THEN 0.8 WHEN primary_type IN ('exclusions', 'eligibility') THEN 0.7 ELSE 0.5 END * chunk_priority), 6) AS priority, round(1.0 - chunk_priority, 6) AS admin_ratio FROM {page_types}""",
    "page_types",
)
def p22_p24_page_ratios(t):
    kind, ratio = F.col("primary_type"), F.col("chunk_priority")
    return t.select("doc_id", "page_number", F.round(X.filterable_ratio(kind, ratio), 6).alias("filterable"), F.round(X.chunk_priority(kind, ratio), 6).alias("priority"), F.round(1.0 - ratio, 6).alias("admin_ratio"))


# More shapes of responses than the fixture's: arrays, comments, wrong keywords, cut ends, nothing at all.
SHAPED = r"""SELECT response_id, CASE response_id % 12 WHEN 4 THEN 'List: [' || content || ', {"k": 1}] end [2' WHEN 5 THEN content || ' // note' WHEN 6 THEN '{"a": {"k": "True"}, "b": "None",' || chr(10) || '"c": [1, 2,]}  ' WHEN 7 THEN 'text } {"k": {"k": 3}} and } more' WHEN 8 THEN '' WHEN 9 THEN '{"k": 5, "open": {' WHEN 10 THEN '[3, 4]' WHEN 11 THEN '[x] and ["y", 7]' ELSE content END AS c FROM {responses}"""


def valid(text: str) -> str:
    """DuckDB takes a comma before a closing bracket; JSON has none."""
    return rf"(json_valid({text}) AND NOT regexp_matches({text}, ',\s*[}}\]]'))"


def first_json(*tries: str) -> str:
    return "CASE " + " ".join(f"WHEN {valid(t)} THEN {t}" for t in tries) + " END"


FENCED, BRACED, BRACKETED = r"regexp_extract(c, '(?s)```(?:json)?\s*(.*?)\s*```', 1)", r"regexp_extract(c, '(?s)(\{.*\})', 1)", r"regexp_extract(c, '(?s)(\[.*\])', 1)"


def repaired_sql(c: str) -> str:
    out = rf"regexp_replace(regexp_replace({c}, ',(\s*[}}\]])', '\1', 'g'), '(?m)//.*?$', '', 'g')"
    for quoted_, plain in (('"True"', "true"), ('"False"', "false"), ('"None"', "null"), ('"null"', "null")):
        out = f"replace({out}, '{quoted_}', '{plain}')"
    return out


DEPTH_AT = "length(replace(left(c, i), '}', '')) - length(replace(left(c, i), '{', ''))"


@query(
    rf"""WITH s AS ({SHAPED}), z AS (SELECT *, (SELECT max(i) FROM (SELECT unnest(range(1, length(c) + 1)) AS i) x WHERE substr(c, i, 1) = '}}' AND {DEPTH_AT} = 0) AS zero FROM s),
    e AS (SELECT *, CASE WHEN zero IS NOT NULL THEN left(c, zero) ELSE regexp_replace(c, '\}}\s*$', '}}') END AS cut, {first_json('c', FENCED, BRACED, BRACKETED)} AS v, list_filter(regexp_extract_all(c, '(?s)\[.*?\]'), lambda x: {valid('x')}) AS parts FROM z)
    SELECT response_id, v IS NOT NULL AS parses, TRY_CAST(CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.k') ELSE json_extract_string(v, '$[0].k') END AS INT) AS k,
      CAST(CASE WHEN {valid('c')} AND json_type(c) = 'ARRAY' THEN json_array_length(c) WHEN {valid('c')} AND json_type(c) = 'OBJECT' THEN 1 WHEN len(parts) > 0 THEN json_array_length(parts[1]) ELSE 0 END AS INT) AS array_size, {repaired_sql('c')} AS repaired, {repaired_sql('cut')} AS emergency,
      CASE WHEN {valid('c')} AND json_type(c) = 'OBJECT' THEN TRUE WHEN {valid(BRACED)} THEN json_type({BRACED}) = 'OBJECT' ELSE FALSE END AS has_object FROM e""",
    "responses",
)
def p26_p29_p37_json(t):
    n = F.col("response_id") % 12
    shapes = {5: F.concat("content", F.lit(" // note")), 4: F.concat(F.lit("List: ["), "content", F.lit(', {"k": 1}] end [2'))}
    fixed = {6: '{"a": {"k": "True"}, "b": "None",\n"c": [1, 2,]}  ', 7: 'text } {"k": {"k": 3}} and } more', 8: "", 9: '{"k": 5, "open": {', 10: "[3, 4]", 11: '[x] and ["y", 7]'}
    c = F.col("content")
    for i, text in [*shapes.items(), *((i, F.lit(x)) for i, x in fixed.items())]:
        c = F.when(n == i, text).otherwise(c)
    rows = t.select("response_id", c.alias("c")).withColumn("v", X.json_value(F.col("c")))
    c = F.col("c")
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    k = F.when(is_object, F.try_variant_get("v", "$.k", "int")).otherwise(F.try_variant_get("v", "$[0].k", "int"))
    return rows.select("response_id", F.col("v").isNotNull().alias("parses"), k.alias("k"), F.size(X.json_array(c)).alias("array_size"), X.repaired_json(c).alias("repaired"), X.balanced_prefix(c).alias("emergency"), X.json_object(c).isNotNull().alias("has_object"))


@query(
    """SELECT condition_id, CASE WHEN ends_with(trim(description), '?') THEN trim(description) WHEN contains(description, 'BMI') OR contains(lower(description), 'age') THEN 'What is your ' || string_split(lower(trim(description)), ' ')[1] || '?'
    WHEN contains(lower(description), 'have') OR contains(lower(description), 'has') THEN 'Do you ' || replace(replace(lower(trim(description)), 'has ', 'have '), 'the patient ', '') || '?' ELSE 'Does the patient meet the following requirement: ' || trim(description) || '?' END AS question
    FROM (SELECT condition_id, CASE ord WHEN 1 THEN 'The patient has ' || description WHEN 2 THEN 'Age over ' || description WHEN 3 THEN description || '?' ELSE description END AS description FROM {conditions}) q""",
    "conditions",
)
def p30_suggest_question(t):
    text = F.when(F.col("ord") == 1, F.concat(F.lit("The patient has "), "description")).when(F.col("ord") == 2, F.concat(F.lit("Age over "), "description")).when(F.col("ord") == 3, F.concat("description", F.lit("?"))).otherwise(F.col("description"))
    return t.select("condition_id", X.suggested_question(text).alias("question"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ', ' || o_orderstatus ELSE o_orderpriority END AS answer FROM {orders}""",
    "orders",
)
def p31_normalise_answer(t):
    listed = F.to_json(F.array("o_orderpriority", "o_orderstatus"))
    return t.select("o_orderkey", X.joined_answer(F.when(F.col("o_orderkey") % 2 == 0, listed).otherwise(F.col("o_orderpriority"))).alias("answer"))


@query("SELECT doc_id, page_number, 'page ' || CAST(page_number AS VARCHAR(9)) AS section, substr(text, 1, 500) AS quoted_text FROM {doc_pages}", "doc_pages")
def p09_source_reference(t):
    ref = X.source_reference(F.col("page_number"), F.concat(F.lit("page "), F.col("page_number").cast("string")), F.col("text"))
    return t.select("doc_id", ref.alias("r")).select("doc_id", "r.*")
