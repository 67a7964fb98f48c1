"""Operator 7: multi-party perspective rotation of dialogues.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users, with the character spans that are trained on.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick

#: Marks around a turn, of which the tail belongs to what is trained on, and what stands before the name of a user.
HEAD, TAIL, NAMED = "<|im_start|>", "<|im_end|>\n", "user name="
#: Roles that set the scene and don't take part: rendered as they are, never as the assistant.
SCENE = ("system",)


def rotate(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, speaker, n_turns, n_trained, text, mask): one row for each conversation and participant.

    Participants are the roles that occur, except ``SCENE``. ``text`` joins the turns in order; ``mask`` lists the
    trained spans as ``start-end`` in characters, end exclusive, joined by commas: each span is a turn of the speaker
    from after its head to the end of its tail. Turns are ordered by (turn, role, text); a null turn comes last. Null
    text is empty text, a null or empty role is ``unknown``, and rows with null conv_id are left out, as they belong to
    no dialogue. Repeated rows are repeated turns. A conversation of scene turns only has no rows. The marks in a text or a role
    are broken up by a zero-width space after ``<``, and line ends in a role become spaces, so that no turn can forge another; the roles that are the same
    after that are one participant. A role called ``assistant`` is a participant like others. Texts of any length and dialogues of any number of turns are
    rendered whole; a dialogue is one row, as its rendering is. Other columns may have any names. An empty table gives no rows.
    """
    rows = pick(turns, conv_id=conv_column, turn=turn_column, role=role_column, text=text_column).where("conv_id is not null")
    broken = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<​|im_"))
    safe = broken(F.coalesce("text", F.lit("")))
    role = broken(F.regexp_replace(F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown")), r"[\r\n]", " "))
    fine = rows.select("conv_id", "turn", role.alias("r"), safe.alias("x"))
    # where each turn would end if every speaker were a named user: own turns then shift by the same number each
    name = F.when(F.col("r").isin(*SCENE), F.concat("r", F.lit("\n"))).otherwise(F.concat(F.lit(NAMED), "r", F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "r", "x").rowsBetween(Window.unboundedPreceding, 0)
    ended = fine.withColumn("e", F.sum(F.length(F.lit(HEAD)) + F.length(name) + F.length("x") + F.length(F.lit(TAIL))).over(order))
    turn = F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("t"), "r", "x", "e")
    talks = ended.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["r"]), lambda r: ~r.isin(*SCENE))))
    each = talks.select("conv_id", "turns", F.explode(speakers).alias("speaker"))

    def shown(t):
        name = F.when(t["r"] == F.col("speaker"), F.lit("assistant\n")).when(t["r"].isin(*SCENE), F.concat(t["r"], F.lit("\n")))
        return F.concat(F.lit(HEAD), name.otherwise(F.concat(F.lit(NAMED), t["r"], F.lit("\n"))), t["x"], F.lit(TAIL))

    shift = F.length(F.lit("assistant")) - F.length(F.lit(NAMED)) - F.length("speaker")

    def span(t, i):
        end = t["e"] + (i + 1) * shift
        return F.concat((end - F.length(t["x"]) - F.length(F.lit(TAIL))).cast("string"), F.lit("-"), end.cast("string"))

    spans = F.transform(F.filter("turns", lambda t: t["r"] == F.col("speaker")), span)
    return each.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["r"] == F.col("speaker"))).cast("long").alias("n_trained"),
        F.array_join(F.transform("turns", shown), "").alias("text"),
        F.array_join(spans, ",").alias("mask"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(regexp_replace(coalesce(nullif(role, ''), 'unknown'), '[\r\n]', ' ', 'g'), '<|im_', '<' || chr(8203) || '|im_') AS r, replace(coalesce(text, ''), '<|im_', '<' || chr(8203) || '|im_') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, r, x) AS k FROM t),
s AS (SELECT DISTINCT conv_id, r AS speaker FROM t WHERE r <> 'system'),
p AS (
  SELECT n.conv_id, speaker, k, r = speaker AS m, x || '<|im_end|>' || chr(10) AS b,
    '<|im_start|>' || CASE WHEN r = speaker THEN 'assistant' WHEN r = 'system' THEN r ELSE 'user name=' || r END || chr(10) AS h
  FROM n JOIN s ON n.conv_id = s.conv_id),
o AS (SELECT *, sum(length(h) + length(b)) OVER (PARTITION BY conv_id, speaker ORDER BY k)::BIGINT AS e FROM p)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (m) AS n_trained, string_agg(h || b, '' ORDER BY k) AS text,
  string_agg((e - length(b))::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY k) FILTER (m) AS mask
FROM o GROUP BY conv_id, speaker
"""
