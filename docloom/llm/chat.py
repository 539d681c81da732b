r"""Chat formatting by a grammar round trip, with DataFrame functions only.

A conversation is rendered as one string, a turn at a time::

    <s>[INST] role [/INST]text</s>

The four control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. `parse` is the deterministic
inverse: it splits at ``</s>``, takes the role up to the first ``[/INST]`` and undoes escapes. A turn is
first rendered as it is and parsed again; only if the parser recovers something else are its role and
text escaped. Escaping doubles each backslash and puts one behind the first character of every
control string, so that none is left whole and the parser can undo it. The finished conversation is
parsed once more, and a conversation that still differs is rendered again with every turn escaped.

Defined results for odd input: a null role or text is empty; turns are ordered by (turn, role, text),
nulls first, so ties and repeated rows keep all their turns in a fixed order; rows with a null
conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
A conversation's turns meet in one row, because the rendered string and its digests are one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[INST] ", "</s>"
MIDDLE = " [/INST]"
_ESCAPED = r"\\|<(?=/?s>)|\[(?=/?INST\])"


def escape(c: Column) -> Column:
    """Text without a whole control string; `unescape` undoes it."""
    return F.regexp_replace(c, _ESCAPED, r"$0\\")


def unescape(c: Column) -> Column:
    """A doubled backslash is one, a single one is dropped."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _fields(piece: Column) -> Column:
    cut = F.instr(piece, MIDDLE)
    return F.struct(
        unescape(F.substring(piece, F.lit(len(OPEN) + 1), cut - (len(OPEN) + 1))).alias("role"),
        unescape(F.substring(piece, cut + len(MIDDLE), F.length(piece))).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """The turns, an array of (role, text), of a rendered string."""
    pieces = F.split(formatted, CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _fields)


def _spans(turns: Column) -> Column:
    """(start, length) of each assistant text in the rendered string; start counts code points from 0."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["out_role"]) + (len(OPEN) + len(MIDDLE))
        span = F.struct(begin.cast("long").alias("start"), F.length(t["out_text"]).cast("long").alias("length"))
        return F.struct(
            (begin + F.length(t["out_text"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    alone = parse(render_turn(F.col("role"), F.col("text")))
    turns = turns.withColumn(
        "plain", F.coalesce(alone == F.array(F.struct("role", "text")), F.lit(False))
    )
    turns = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"))).alias("out_role"),
            F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))).alias("out_text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def joined(ts: Column) -> Column:
        return F.array_join(F.transform(ts, lambda t: render_turn(t["out_role"], t["out_text"])), "")

    whole = whole.select("conv_id", "turns", joined(F.col("turns")).alias("formatted"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = whole.withColumn("same", parse(F.col("formatted")) == source)
    all_escaped = F.transform(
        "turns",
        lambda t: F.struct(
            t["turn"].alias("turn"),
            t["role"].alias("role"),
            t["text"].alias("text"),
            escape(t["role"]).alias("out_role"),
            escape(t["text"]).alias("out_text"),
        ),
    )
    whole = whole.select("conv_id", F.when(F.col("same"), F.col("turns")).otherwise(all_escaped).alias("turns"))
    return whole.select("conv_id", joined(F.col("turns")).alias("formatted"), _spans(F.col("turns")).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output says: turns from the parser, loss text from the spans."""
    read = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        parse(F.col("formatted")).alias("turns"),
        F.array_join(
            F.transform(
                "loss_spans",
                lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
            ),
            "",
        ).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


CONFLICT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflict = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONFLICT).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return read_back(format_conversations(rows.unionByName(conflict)))


SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
marked AS (
  SELECT *, len(regexp_extract_all(role || chr(10) || text, '\\|</?s>|\[/?INST\]')) AS marks,
         contains(role || chr(10) || text, '\') OR contains(text, '</s>') OR regexp_matches(role, '</s>| \[/INST\]') AS conflict
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(len(role) + len(text) + {len(OPEN) + len(MIDDLE) + len(CLOSE)} + CASE WHEN conflict THEN marks ELSE 0 END)::BIGINT
         AS formatted_chars
FROM marked GROUP BY conv_id
"""
