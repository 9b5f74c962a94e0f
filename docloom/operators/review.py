"""The review domain: best answers, decisions, questions, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.scan import running_sums

NOT_FOUND = "NOT_FOUND"
# Seconds of set-up, per item and of consolidation by kind of document.
TIMES = {"policy": (10, 35, 15), "application": (8, 25, 12), "decision": (3, 2, 8)}


def found(answer: Column) -> Column:
    return F.coalesce((answer != NOT_FOUND) & (F.trim(answer) != ""), F.lit(False))


def best_answers(answers: DataFrame) -> DataFrame:
    """Per session and question: a found answer beats none, the longer one wins, the first on ties."""
    is_found = found(F.col("answer_text"))
    rank = F.struct(is_found, F.when(is_found, F.length("answer_text")).otherwise(0), -F.col("chunk_ord"))
    return answers.groupBy("session_id", "question_id").agg(F.max_by("answer_text", rank).alias("answer_text"), F.count(F.lit(1)).alias("n_chunks"))


def answers_found(answers: DataFrame) -> DataFrame:
    is_found = found(F.col("answer_text"))
    return answers.groupBy("session_id").agg(F.count_if(is_found).alias("n_found"), F.count_if(~is_found).alias("n_missing"))


def requirement_counts(answers: DataFrame) -> DataFrame:
    """``answers(session_id, answer_text, meets_requirement, risk_assessment)``: counts, risk, and whether the rule approves."""
    is_found = found(F.col("answer_text"))
    kind = F.when(~is_found, "missing").when(F.col("meets_requirement") == "Yes", "met").when(F.col("meets_requirement") == "No", "not_met").otherwise("unclear")
    rows = answers.withColumn("kind", kind).groupBy("session_id")
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("met", "not_met", "missing", "unclear")],
        F.bool_or(F.col("risk_assessment") == "High").alias("critical"),
    )
    return counts.withColumns(
        {
            "overall_risk": F.when(F.col("critical") | (F.col("not_met") > 3), "High").when((F.col("missing") > 5) | (F.col("unclear") > 3), "Medium").otherwise("Low"),
            "approve_by_rule": (F.col("met") >= F.floor(F.col("total") * 0.75)) & (F.col("not_met") <= 2),
        }
    )


def batches(answers: DataFrame, size: int = 15) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("question_id"))
    return answers.withColumn("batch", F.floor((nth - 1) / size))


def renumbered(questions: DataFrame, group: str, order: list[str]) -> DataFrame:
    return questions.withColumn("order_index", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def consolidated(questions: DataFrame, per_chunk: int = 4, overlap: float = 0.7, most: int = 25) -> DataFrame:
    """Per policy, of each chunk's longest questions those whose words don't overlap one kept before, in order.

    ``questions(policy_id, chunk_id, ord, text)``. The fold runs over at most ``per_chunk`` rows of a chunk.
    """
    best = top_per_group(questions, ["policy_id", "chunk_id"], [F.desc(F.length("text")), F.col("ord")], per_chunk)
    word_set = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    listed = best.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "nth", "text", word_set.alias("words")))).alias("q"))
    kept = F.aggregate(
        "q",
        F.slice("q", 1, 0),
        lambda acc, q: F.when(
            (F.size(acc) < most) & ~F.exists(acc, lambda k: F.size(F.array_intersect(k["words"], q["words"])) > overlap * F.size(q["words"])),
            F.array_append(acc, q),
        ).otherwise(acc),
    )
    return listed.select("policy_id", F.size("q").alias("n_before"), kept.alias("kept")).select(
        "policy_id", "n_before", F.size("kept").alias("n_kept"), F.round(100 * (1 - F.size("kept") / F.col("n_before")), 1).alias("reduction"), F.transform("kept", lambda k: k["text"]).alias("texts")
    )


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call; ``prices(model, input_price, output_price)`` per million tokens, a short list of models."""
    cost = F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price")
    return calls.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0)))


def cost_totals(costs: DataFrame) -> DataFrame:
    """By model with a total row (model null): sums, calls, cost per million tokens."""
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    return costs.rollup("model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"),
        F.count(F.lit(1)).alias("calls"),
        F.round(F.when(tokens > 0, F.sum("cost") / tokens * 1e6), 6).alias("per_million"),
    )


def merged_values(values: DataFrame, group: str, key: str, value: str, ord_: str) -> DataFrame:
    """Per key the last real value, or the last empty one where there is none."""
    real = F.coalesce(F.trim(value) != "", F.lit(False))
    return values.groupBy(group, key).agg(F.max_by(value, F.struct(real, F.col(ord_))).alias(value))


def time_estimate(kind: Column, items: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, (setup, unit, rest) in TIMES.items():
        out = F.when(kind == name, setup + items * unit + rest).otherwise(out)
    return out


def by_keys(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key another table asks for."""
    return table.join(asked.select(key).distinct(), key, "left_semi")


def updated_status(sessions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``sessions`` with the status of ``changes(id, status, recommendation)``: a recommendation only where one is given, and the time of completion."""
    new = changes.select("id", F.col("status").alias("__status"), F.nullif(F.col("recommendation"), F.lit("")).alias("__rec"))
    return sessions.join(new, "id", "left").select(
        "id",
        F.coalesce("__status", "status").alias("status"),
        F.coalesce("__rec", "final_recommendation").alias("final_recommendation"),
        F.when(F.col("__status").isin("Completed", "completed"), now).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def approved(questionnaires: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """``questionnaires(id, ..., is_approved, approved_at)`` with those of ``asked(id)`` approved at ``now``."""
    marked = questionnaires.join(asked.select("id", F.lit(True).alias("__now")).distinct(), "id", "left")
    hit = F.coalesce("__now", F.lit(False))
    return marked.select(*[(F.col("is_approved") | hit).alias(c) if c == "is_approved" else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "approved_at" else F.col(c) for c in questionnaires.columns])


def pending(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("status").isin("pending", "Pending"))


def decided(sessions: DataFrame) -> DataFrame:
    """Completed sessions with a recommendation."""
    return sessions.where((F.col("status") == "completed") & (F.coalesce("final_recommendation", F.lit("")) != ""))


def reconciled_name(entered: Column, extracted: Column) -> Column:
    """The extracted name where it is a real one and longer."""
    real = (F.coalesce(extracted, F.lit("")) != "") & (extracted != "Not Found")
    return F.when(real & (F.length(F.trim(extracted)) > F.length(F.trim(entered))), extracted).otherwise(entered)


def answer_payload(answers: DataFrame) -> DataFrame:
    """What a decision gets of each of ``answers(id, answer_text, reasoning, clinical_rationale, source_page_number)``."""
    reasoning = F.coalesce(F.nullif(F.col("reasoning"), F.lit("")), F.nullif(F.col("clinical_rationale"), F.lit("")), F.lit(""))
    confidence = F.when(F.col("answer_text").isin("NOT_FOUND", "Not Found"), 0).otherwise(95)
    pages = F.when(F.coalesce("source_page_number", F.lit(0)) != 0, F.col("source_page_number").cast("string")).otherwise("")
    return answers.select("id", "answer_text", reasoning.alias("reasoning"), confidence.alias("confidence_score"), pages.alias("page_references"))


CHUNK_BOUNDS, DOCUMENT_BOUNDS = (5, 12), (10, 25)


def bounded_questions(questions: DataFrame, group: list[str], order: list[str], bounds: tuple[int, int]) -> DataFrame:
    """The first questions of each group, as many as the upper bound allows, with ``n_questions``, all that there were, and whether these are ``too_few``."""
    least, most = bounds
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    counted = questions.withColumns({"n_questions": n, "too_few": n < least})
    return top_per_group(counted, group, [F.col(o) for o in order], most).drop("nth")


def question_counts(questions: DataFrame, group: str, least: int, most: int) -> DataFrame:
    """(group, n, kept, too_few): how many questions a group has, how many the upper bound lets stay, and whether they are fewer than the lower one."""
    n = F.count(F.lit(1))
    return questions.groupBy(group).agg(n.alias("n"), F.least(n, F.lit(most)).alias("kept"), (n < least).alias("too_few"))


def summarised_questions(questions: DataFrame, most: int = 10, text: int = 200, source: int = 100) -> DataFrame:
    """The first questions of each chunk, cut, with defaults: ``questions(chunk_id, ord, question_id, question_text, question_type, criterion_type, priority, source_text_snippet, page_number)``."""
    first = top_per_group(questions, ["chunk_id"], [F.col("ord")], most)
    return first.select(
        "chunk_id",
        "ord",
        F.coalesce("question_id", F.lit("")).alias("question_id"),
        F.left(F.coalesce("question_text", F.lit("")), F.lit(text)).alias("question_text"),
        *[F.coalesce(c, F.lit(default)).alias(c) for c, default in (("question_type", "text"), ("criterion_type", "general"), ("priority", "medium"))],
        F.left(F.coalesce("source_text_snippet", F.lit("")), F.lit(source)).alias("source_text_snippet"),
        "page_number",
    )


def applications_latest(applications: DataFrame, files: DataFrame) -> DataFrame:
    """Applications with their file, latest submission first, ties by id: ``applications(application_id, file_id, submission_date)``, ``files(file_id, filename)``."""
    return applications.join(files, "file_id", "left").orderBy(F.desc("submission_date"), "application_id")


def sessions_of_applications(sessions: DataFrame, questionnaires: DataFrame, answers: DataFrame) -> DataFrame:
    """Per application its sessions as structs, latest first, each with its questionnaire and its answers in order.

    ``sessions(session_id, application_id, questionnaire_id, created_at, status)``, ``questionnaires(questionnaire_id, name)``,
    ``answers(session_id, question_id, answer_text)``.
    """
    listed = answers.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("question_id", "answer_text"))).alias("answers"))
    named = questionnaires.select("questionnaire_id", F.struct("questionnaire_id", "name").alias("questionnaire"))
    rows = sessions.join(named, "questionnaire_id", "left").join(listed, "session_id", "left")
    latest = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "session_id")
    one = F.struct("session_id", "status", "questionnaire", F.coalesce("answers", F.array().cast(listed.schema["answers"].dataType)).alias("answers"))
    ordered = F.array_sort(F.collect_list(F.struct(latest.alias("o"), one.alias("s"))))
    return rows.groupBy("application_id").agg(F.transform(ordered, lambda x: x.s).alias("sessions"))


def cost_timeline(entries: DataFrame) -> DataFrame:
    """Entries in order of time with what was spent up to each: ``entries(timestamp, entry_id, description, cost)``. No task holds them all.

    A cost that is not given counts as nothing, a description as ``Processing``.
    """
    known = entries.withColumns({"cost": F.coalesce("cost", F.lit(0.0)), "description": F.coalesce("description", F.lit("Processing")), "__one": F.lit(0)})
    summed = running_sums(known, "__one", ["timestamp", "entry_id"], "cost").withColumnRenamed("running", "spent")
    return summed.select("timestamp", "entry_id", "description", "cost", "spent").orderBy("timestamp", "entry_id")
