"""Chat formatting by prefix-target expansion. DataFrame operations only.

Every assistant turn becomes an example of its own: all earlier turns are its context and only that reply is
trainable. What follows the last assistant turn (or a conversation without one) becomes one more example with
no trainable text, so that no turn is lost.

The template writes `<s>` once, then `[INST]role[/INST]text</s>` for each turn. In roles and texts `&` becomes
`&amp;` and the first character of each control string becomes an entity, so no control string is left inside,
and `unescape` gives back the very same characters.

Defined results: null text or role is empty; null turn numbers come first; equal turn numbers are ordered by
role, then text; repeated rows are repeated turns; rows with a null id form a conversation of their own. An
empty table gives an empty result; extra columns are ignored. An example holds its whole context, so the
output grows with the square of a conversation's turns: that is the expansion itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings.
BEGIN, ROLE_OPEN, ROLE_CLOSE, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.regexp_replace(text, r"<(/?s>)", "&lt;$1")
    return F.regexp_replace(text, r"\[(/?INST\])", "&#91;$1")


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target_turn, has_target, formatted, loss_start, loss_length), one row for each example.

    `target_turn` counts from 0. The loss mask is the `loss_length` characters of `formatted` from `loss_start`
    (from 0): the reply's escaped text, without any marker.
    """
    empty = F.lit("")
    role, text = F.coalesce(F.col("role"), empty), F.coalesce(F.col("text"), empty)
    rendered = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE), escape(text), F.lit(TURN_END))
    one = F.struct(
        F.col("turn"),
        role.alias("role"),
        rendered.alias("rendered"),
        F.length(escape(text)).alias("n"),
    )
    by = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # array_sort puts null turn numbers first inside structs
    last = F.size("ts") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(F.col("ts"), i)["role"] == TARGET_ROLE) | (i == last))
    at = F.get(F.col("ts"), F.col("target_turn"))
    text_of = F.concat(F.lit(BEGIN), F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("target_turn") + 1), lambda t: t["rendered"]), ""))
    has = at["role"] == TARGET_ROLE
    return (
        by.select("conv_id", "ts", F.explode(wanted).alias("target_turn"))
        .select("conv_id", "target_turn", has.alias("has_target"), text_of.alias("formatted"), at["n"].alias("n"))
        .select(
            "conv_id",
            "target_turn",
            "has_target",
            "formatted",
            F.when(F.col("has_target"), F.length("formatted") - len(TURN_END) - F.col("n")).otherwise(0).alias("loss_start"),
            F.when(F.col("has_target"), F.col("n")).otherwise(0).alias("loss_length"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    pieces = F.split(body, TURN_END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ROLE_CLOSE, 1)
        return F.struct(
            unescape(F.substring(head, len(ROLE_OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(ROLE_CLOSE) + 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own control strings, read back from the examples."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"),
        F.lit(said).alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    examples = prefix_target_examples(turns.unionByName(planted))
    masked = unescape(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    whole = read_turns(F.col("longest"))
    told = F.array_join(F.transform(whole, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    losses = F.array_join(F.transform(F.array_sort("losses"), lambda x: x["text"]), "")
    return (
        examples.groupBy("conv_id")
        .agg(
            F.max_by("formatted", "target_turn").alias("longest"),
            F.collect_list(F.struct("target_turn", masked.alias("text"))).alias("losses"),
            F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
            F.sum(F.col("has_target").cast("long")).alias("n_examples"),
        )
        .select(
            "conv_id",
            F.size(whole).cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length(losses).cast("long").alias("loss_chars"),
            F.sha2(losses, 256).alias("loss_sha256"),
            "formatted_chars",
            "n_examples",
        )
    )


_ESCAPED = r"regexp_replace(regexp_replace(replace({0}, '&', '&amp;'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g')"
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m,
    3 + sum({len(ROLE_OPEN) + len(ROLE_CLOSE) + len(TURN_END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) OVER w AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, max(m) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM n GROUP BY conv_id
"""
