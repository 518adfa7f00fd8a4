"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

#: A turn is MARK, the role, a line feed, the text and END.
MARK, END = "### ", "</turn>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """The text with a backslash before each backslash and within each mark of the template, so that it holds no mark."""
    for plain, marked in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("###", "\\#\\#\\#")):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/#])", "$1")


def header(role: Column) -> Column:
    """The role in one line: per cent signs and line feeds as %25 and %0A."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def role_of(head: Column) -> Column:
    return F.replace(F.replace(head, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def prefix_targets(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One example for each assistant turn, with all turns before it as context: (id_col, _example from 1, _text, _loss_from, _loss_to).

    _text is a prefix of the formatted conversation. The code points from _loss_from to before _loss_to are trained on: the text of the example's last turn, as it stands
    there (escaped), without header and end mark. A conversation that does not end with an assistant turn has one further example, of all its turns, with an empty
    stretch, so that no turn is left out of the output.

    Null texts and roles are empty ones. Turns are ordered by turn number (null last), ties by role and text; repeated rows are turns of their own. Rows with a null id
    are one conversation. Empty table: no rows. Texts stay whole. Further columns belong to turns and are left out. One shuffle by conversation; a
    conversation's turns meet in one row, as its last example is to hold them all, and examples are made from it one after another. What comes out grows with the square of
    a conversation's turns: the contexts are asked for whole.
    """
    text = escaped(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = turns.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{turn_col}`").alias("_turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("_role"), text.alias("_body"))
    rows = rows.withColumn("_piece", F.concat(F.lit(MARK), header(F.col("_role")), F.lit("\n"), "_body", F.lit(END)))
    order = Window.partitionBy("_id").orderBy(F.col("_turn").asc_nulls_last(), "_role", F.col("_piece"))
    rows = rows.select(
        "_id", F.row_number().over(order).alias("pos"), F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("to"),
        F.length("_body").alias("size"), (F.col("_role") == TRAINED).alias("trained"), F.col("_piece").alias("piece"))
    whole = rows.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", "to", "size", "trained", "piece"))).alias("turns"))
    ends = F.filter("turns", lambda t: t["trained"] | (t["pos"] == F.size("turns")))
    one = whole.select("_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.posexplode(ends).alias("k", "t"))
    to = F.col("t.to") - len(END)
    return one.select(
        F.col("_id").alias(id_col), (F.col("k") + 1).alias("_example"), F.substring("formatted", F.lit(1), F.col("t.to").cast("int")).alias("_text"),
        F.when(F.col("t.trained"), to - F.col("t.size")).otherwise(F.col("t.to")).alias("_loss_from"), F.when(F.col("t.trained"), to).otherwise(F.col("t.to")).alias("_loss_to"))


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation say: (id_col, _turns: array of role and text, _replies: the texts under the loss in order, unescaped, _chars of all examples)."""
    under = F.substring("_text", (F.col("_loss_from") + 1).cast("int"), (F.col("_loss_to") - F.col("_loss_from")).cast("int"))
    of = examples.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(
        F.max_by("_text", "_example").alias("whole"), F.sum(F.length("_text").cast("long")).alias("_chars"),
        F.sort_array(F.collect_list(F.when(F.col("_loss_to") > F.col("_loss_from"), F.struct("_example", under.alias("reply"))))).alias("replies"))
    pieces = F.split("whole", END, -1)
    head = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(
        role_of(F.substring(head(p), F.lit(len(MARK) + 1), F.length(p))).alias("role"), unescaped(F.substring(p, F.length(head(p)) + 2, F.length(p))).alias("text"))
    return of.select(
        F.col("_id").alias(id_col), F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("_turns"),
        F.transform("replies", lambda r: unescaped(r["reply"])).alias("_replies"), "_chars")


#: The texts of conversation -7, which look like the template.
TRAP = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(TRAP).alias("text"))
    rows = read_back(prefix_targets(turns.unionByName(trap)))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    replies = F.array_join("_replies", "")
    return rows.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(replies).cast("long").alias("loss_chars"),
        F.sha2(replies, 256).alias("loss_sha256"), F.col("_chars").alias("formatted_chars"))


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, '{TRAINED}', '{TRAP}'),
sized AS (SELECT *, length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + length(replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '###', '\\#\\#\\#')) + {len(MARK) + 1 + len(END)} AS size FROM c),
placed AS (
  SELECT *, sum(size) OVER w AS fin, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED}'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256,
  sum(fin) FILTER (WHERE role = '{TRAINED}' OR pos = n)::bigint AS formatted_chars
FROM placed GROUP BY conv_id"""
