"""Chat formatting by schema fingerprints (DataFrame functions only).

A record's layout is the set of its nested field paths. Its fingerprint, a hash of
the sorted paths that any mapping knows, selects a declarative mapping, and that
turns prompt/response pairs, instruction records and message lists into canonical
turns (role, text). Fields that no mapping knows don't change the fingerprint.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts
and roles every ``<|`` gets a backslash after the ``<`` (and ``<\\|`` another one),
so control strings never occur inside a text and unescaping is exact; in roles, a
backslash becomes ``\\s`` and a line feed ``\\n``.

Long conversations are formatted in parts of ``TURNS_IN_PART`` turn numbers, each a row of
its own, so no task holds more turns of one conversation than have these numbers (rows that share a number, or
have none, are in one part) before the end. The loss
mask is a list of spans, in code points, of each part.

Defined results: a null text or role is an empty string; a null turn comes first, before
negative ones, and rows that share a turn are ordered by role, then text; roles are kept as they
are, but that of ``from``/``value`` lists have the names of the others; a null ``conv_id`` is a
conversation of its own; a record without a known layout, or whose JSON doesn't parse,
gives no turns and is returned by ``unknown_layouts``; repeated rows are repeated turns;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS_IN_PART = 64
START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"

# A mapping: the known paths of a layout and the expression that gives its turns; ``v`` is the record as a variant.
# [*] stands for the elements of an array.
_FIELD = "try_variant_get(v, '$.{0}', 'string')"


def _single(*turns: tuple[str, str]) -> str:
    made = ", ".join(f"named_struct('role', '{role}', 'text', {text})" for role, text in turns)
    return f"filter(array({made}), t -> t.text is not null)"


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    named = f"m.{role}" if not names else "CASE m." + role + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE m.{role} END"
    return f"transform(try_variant_get(v, '$.{path}', 'array<struct<{role}:string,{text}:string>>'), m -> named_struct('role', {named}, 'text', coalesce(m.{text}, '')))"


# Role names of ``from``/``value`` lists. Fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


_PAIR = [("prompt", "response"), ("prompt", "completion"), ("question", "answer")]
LAYOUTS: dict[tuple[str, ...], str] = {
    ("role", "text", "turn"): "array(named_struct('role', try_variant_get(v, '$.role', 'string'), 'text', coalesce(try_variant_get(v, '$.text', 'string'), '')))",
    ("messages[*].content", "messages[*].role"): _list("messages", "role", "content"),
    ("messages[*].role", "messages[*].text"): _list("messages", "role", "text"),
    ("conversations[*].from", "conversations[*].value"): _list("conversations", "from", "value", ROLES),
    ("instruction", "output"): _single(("user", _FIELD.format("instruction")), ("assistant", _FIELD.format("output"))),
    ("input", "instruction", "output"): _single(
        ("user", f"concat_ws('\n\n', {_FIELD.format('instruction')}, nullif({_FIELD.format('input')}, ''))"), ("assistant", _FIELD.format("output"))
    ),
} | {tuple(sorted(p)): _single(("user", _FIELD.format(p[0])), ("assistant", _FIELD.format(p[1]))) for p in _PAIR}


def path_hash(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _below(root: str):
    return lambda key: F.concat(F.lit(f"{root}[*]."), key)


def field_paths(variant: Column) -> Column:
    """The sorted nested field paths of a record that some mapping knows; null for what isn't a record."""
    known = sorted({p for paths in LAYOUTS for p in paths})
    found = F.map_keys(F.try_variant_get(variant, "$", "map<string,variant>"))
    for root in sorted({p.split("[*].")[0] for p in known if "[*]." in p}):
        elements = F.try_variant_get(variant, f"$.{root}", "array<map<string,variant>>")
        keys = F.flatten(F.transform(elements, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))
        found = F.concat(found, F.coalesce(F.transform(keys, _below(root)), F.array().cast("array<string>")))
    return F.array_sort(F.array_intersect(found, F.array(*map(F.lit, known))))


def fingerprint(variant: Column) -> Column:
    return F.sha2(F.array_join(field_paths(variant), "\n"), 256)


def canonical_turns(records: DataFrame) -> DataFrame:
    """``records(conv_id, seq, v)`` as rows (conv_id, seq, pos, role, text).

    v: the record as a variant; seq: its order within the conversation; pos: the turn's
    order within the record.
    """
    marked = records.withColumn("__layout", fingerprint(F.col("v")))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for paths, expression in LAYOUTS.items():
        turns = F.when(F.col("__layout") == path_hash(paths), F.expr(expression).cast(f"array<{TURN}>")).otherwise(turns)
    rows = marked.select("conv_id", "seq", F.posexplode(turns).alias("pos", "t"))
    return rows.select("conv_id", "seq", "pos", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def unknown_layouts(records: DataFrame) -> DataFrame:
    return records.where(F.col("v").isNull() | ~fingerprint(F.col("v")).isin([path_hash(p) for p in LAYOUTS]))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # Every backslash that is left has one of the two letters behind it.
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` of ``canonical_turns`` as rows (conv_id, part, formatted, loss_spans).

    loss_spans: (start, length) of the texts of ``loss_role`` in ``formatted``, in code points.
    """
    part = F.expr(f"(seq - pmod(seq, {TURNS_IN_PART})) div {TURNS_IN_PART}")  # null, which sorts first, where seq is
    parts = turns.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "role", "text"))).alias("t"))
    pieces = F.transform("t", lambda x: F.struct(F.concat(F.lit(START), _role_out(x.role), F.lit("\n")).alias("head"), escaped(x.text).alias("body"), (x.role == loss_role).alias("loss")))
    size = len(END)
    folded = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x["head"]) + F.length(x["body"]) + size).alias("at"),
            F.when(x["loss"], F.concat(acc.spans, F.array(F.struct((acc.at + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc.spans).alias("spans"),
        ),
    )
    return parts.select("conv_id", "part", pieces.alias("pieces")).select(
        "conv_id",
        "part",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        folded.spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` of ``format_chats`` with ``turns`` (role, text) and ``loss_text`` read from it."""
    bodies = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(START) + 1))
        cut = F.instr(inner, "\n")
        return F.struct(_role_in(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(inner, cut + 1)).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s.start + 1, s.length))), "")
    return formatted.select("*", F.transform(bodies, turn).alias("turns"), loss.alias("loss_text"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its parts as read back."""
    read = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = read.select("conv_id", "part", F.size("turns").alias("n"), lines.alias("lines"), "loss_text", F.length("formatted").alias("chars"))

    def joined(column: str) -> Column:
        return F.array_join(F.transform("p", lambda x: x[column]), "")

    return (
        parts.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum(F.length("loss_text")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("part", "lines", "loss_text"))).alias("p"))
        .select("conv_id", "n_turns", F.sha2(joined("lines"), 256).alias("turns_sha256"), "loss_chars", F.sha2(joined("loss_text"), 256).alias("loss_sha256"), "formatted_chars")
    )
