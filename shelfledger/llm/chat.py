"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as
the assistant and all others as named users; only the assistant's own turns are trained on.

The result has one row per message and perspective, in dialogue order by ``turn``, so a conversation of any length is
never gathered in one place.  ``dialogues`` puts bounded ones together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import columns

START, END = "<|im_start|>", "<|im_end|>"
#: Speakers of this name set the scene; they take no perspective.
NARRATORS = ("system",)
UNNAMED = "unknown"


def _speaker(name: Column) -> Column:
    """Speaker without outer spaces; one without a name is called UNNAMED, and who is called so gets a mark."""
    name = F.nullif(F.trim(name), F.lit(""))
    marked = F.when(name.rlike(f"^{UNNAMED}#*$"), F.concat(name, F.lit("#"))).otherwise(name)
    return F.coalesce(marked, F.lit(UNNAMED))


def _shown(speaker: Column) -> Column:
    """Name of a user in a turn's head, a different one for every speaker.

    White space and marker characters become underscores; a name changed by that, or with a # of its
    own, is followed by # and a digest of the speaker.
    """
    plain = F.regexp_replace(speaker, r"[\s<>|]+", "_")
    digest = F.concat(plain, F.lit("#"), F.substring(F.md5(speaker.cast("binary")), 1, 12))
    return F.when(plain.eqNullSafe(speaker) & ~speaker.contains("#"), plain).otherwise(digest)


def _clean(text: Column) -> Column:
    """Markers inside a text are broken up, so that they cannot end a turn."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|", "< |")


def participants(
    messages: DataFrame, narrators: tuple[str, ...] = NARRATORS
) -> DataFrame:
    """(conv_id, perspective, first_turn) of every speaker of a conversation."""
    own = messages.filter(~F.col("speaker").isin(*narrators)) if narrators else messages
    return own.groupBy("conv_id", F.col("speaker").alias("perspective")).agg(
        F.min("turn").alias("first_turn")
    )


def rotate(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrators: tuple[str, ...] = NARRATORS,
) -> DataFrame:
    """One row per message and perspective.

    Columns: conv_id, perspective, turn, role (system, user or assistant), name (of a user), segment
    (the rendered turn), train (whether its content is trained on), and the code points
    ``train_start`` to ``train_end`` of the segment that the mask keeps (both 0 if none): the content
    and the end marker.

    Null and empty texts give empty turns, a null or blank speaker is called ``unknown``, null ids form one conversation,
    null turns stay null.  Different speakers have different names, also if their names differ in white space only, or
    if one is called ``unknown``.  Repeated messages are rendered each.  A conversation of narrators alone has no
    perspective and no rows; neither has an empty table.  Texts of any length are rendered whole, and other columns,
    whatever their names, are left out.
    """
    said = columns(conversations, conv_id, turn, speaker, text).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        _speaker(F.col(speaker)).alias("speaker"),
        _clean(F.col(text)).alias("content"),
    )
    who = participants(said, narrators).select(F.col("conv_id").alias("of"), "perspective")
    rows = said.join(who, F.col("conv_id").eqNullSafe(F.col("of")))
    narrator = F.col("speaker").isin(*narrators) if narrators else F.lit(False)
    own = ~narrator & (F.col("speaker") == F.col("perspective"))
    role = F.when(narrator, "system").when(own, "assistant").otherwise("user")
    rows = rows.withColumns(
        {
            "role": role,
            "train": own,
            "name": F.when(role == "user", _shown(F.col("speaker"))),
        }
    )
    head = F.concat(
        F.lit(START), F.col("role"),
        F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"),
    )
    segment = F.concat(head, F.col("content"), F.lit(f"{END}\n"))
    keep = F.length("content") + len(END)
    return rows.select(
        "conv_id", "perspective", "turn", "role", "name", "train",
        segment.alias("segment"),
        F.when(own, F.length(head)).otherwise(0).cast("long").alias("train_start"),
        F.when(own, F.length(head) + keep).otherwise(0).cast("long").alias("train_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans): whole renderings with the spans trained on.

    For conversations that fit a row; turns of equal number come in order of their segments.
    """
    listed = rotated.groupBy("conv_id", "perspective").agg(
        F.array_sort(F.collect_list(F.struct("turn", "segment", "train_start", "train_end"))).alias("t")
    )
    step = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["segment"])).alias("at"),
            F.when(
                x["train_end"] > 0,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + x["train_start"]).alias("start"), (acc["at"] + x["train_end"]).alias("end"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("t", lambda x: x["segment"]), "")
    return listed.select("conv_id", "perspective", text.alias("text"), step["spans"].alias("spans"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    return f"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN
      trim(role) || CASE WHEN regexp_full_match(trim(role), '{UNNAMED}#*') THEN '#' ELSE '' END
    ELSE '{UNNAMED}' END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
), who AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), rows AS (
  SELECT s.*, perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
), named AS (
  SELECT *, CASE WHEN role = 'user' THEN regexp_replace(speaker, '[\\s<>|]+', '_', 'g')
    || CASE WHEN regexp_matches(speaker, '[\\s<>|#]') THEN '#' || substr(md5(speaker), 1, 12) ELSE '' END
    END AS name FROM rows
), headed AS (
  SELECT *, '{START}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named
)
SELECT conv_id, perspective, turn, role, name, role = 'assistant' AS train,
  head || content || '{END}' || chr(10) AS segment,
  CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END::BIGINT AS train_start,
  CASE WHEN role = 'assistant' THEN length(head) + length(content) + {len(END)} ELSE 0 END::BIGINT AS train_end
FROM headed
"""
