"""Chat formatting (operator 2), native: DataFrame functions only.

A declarative template names the markers around a turn, the roles whose text is trained on, the control strings
that a text must not smuggle in, and the transitions of a finite-state machine over roles.  One aggregation by
conversation gathers its turns; everything else is higher-order functions on that array: the machine folds over the
roles, each turn becomes three segments (marker, text, marker) with a loss flag, and the formatted string is their
concatenation.

Escaping is reversible: backslashes are doubled, and each control string gets backslash-hyphen after its first
character, so no control string is left in a text; reading back undoes both in one pass.

A conversation is one output row, so its turns meet in one task by definition; the shuffle is by conversation and a
common text or first turn changes nothing.

Defined results: null text and null role count as empty; turns that tie are ordered by role and text, repeated rows
are turns each; a null conversation id is one conversation; a conversation that breaks the turn order is formatted too,
with ``valid`` false and ``first_bad_turn`` its position from 0; other columns are left alone; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = {
    "begin": "<|im_start|>",
    "role_end": "<|im_sep|>",
    "end": "<|im_end|>\n",
    "train_on": ["assistant"],
    "control": ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"],
    "start": "start",
    "transitions": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
}


def _quoted(text: str) -> str:
    """A Java regular expression for ``text`` itself."""
    return "".join("\\" + c if not c.isalnum() and c not in " \n" else c for c in text)


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    firsts = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in sorted(template["control"], key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), firsts, r"\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def format_chat(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, valid, first_bad_turn, segments array<struct<text, loss>>, formatted."""
    empty = F.lit("")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))))
    by = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def step(state: Column, turn: Column) -> Column:
        after = F.lit("invalid")
        for (at, role), to in template["transitions"].items():
            after = F.when((state["at"] == at) & (turn["role"] == role), F.lit(to)).otherwise(after)
        bad = F.when(state["bad"].isNotNull(), state["bad"]).when(after == "invalid", state["n"])
        return F.struct(after.alias("at"), bad.alias("bad"), (state["n"] + 1).alias("n"))

    machine = F.aggregate("turns", F.struct(F.lit(template["start"]).alias("at"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n")), step)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(turn: Column) -> Column:
        head = F.concat(F.lit(template["begin"]), escape(turn["role"], template), F.lit(template["role_end"]))
        off = F.lit(False)
        return F.array(segment(head, off), segment(escape(turn["text"], template), turn["role"].isin(template["train_on"])), segment(F.lit(template["end"]), off))

    return (
        by.select("conv_id", machine["bad"].alias("first_bad_turn"), F.flatten(F.transform("turns", of)).alias("segments"))
        .withColumn("valid", F.col("first_bad_turn").isNull())
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "valid", "first_bad_turn", "segments", "formatted")
    )


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    bodies = F.slice(F.split(formatted, _quoted(template["end"])), F.lit(1), F.size(F.split(formatted, _quoted(template["end"]))) - 1)

    def of(body: Column) -> Column:
        parts = F.split(F.substr(body, F.lit(len(template["begin"]) + 1)), _quoted(template["role_end"]), 2)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(bodies, of)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, digests read back from the formatted output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    out = format_chat(rows.unionByName(extra))
    out = out.select("conv_id", "valid", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql_formatted_length(template: dict = TEMPLATE) -> str:
    """SQL for the length of a formatted turn: markers, role and text, and what escaping adds to both."""
    extra = lambda c: f"(length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + 2 * (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in template["control"]) + ")"
    fixed = len(template["begin"]) + len(template["role_end"]) + len(template["end"])
    return f"{fixed} + length(role) + length(text) + {extra('role')} + {extra('text')}"


SQL = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum({_sql_formatted_length()}) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ({", ".join(f"'{a}>{b}'" for a, b in TEMPLATE["transitions"])})) AS valid
  FROM w GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM c"""
