"""Chat formatting with Spark expressions only: sort, merge adjacent turns of a role, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Template: every block of adjacent turns of one role is "### role", a line break, its texts with PART between, and END.
HEAD, PART, END = "### ", "</part>", "</turn>\n"
#: Turns whose lengths are summed in one run; keeps running sums of very long conversations cheap.
_RUN = 512


def escape(text: Column, line: bool = False) -> Column:
    """Keep control strings out of a text: no bare '#' and no '</' are left. ``line`` hides line breaks too."""
    text = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if line else text


def unescape(text: Column, line: bool = False) -> Column:
    """The text that ``escape`` was given. Doubled backslashes are parted first, so they never join other marks."""
    def plain(part: Column) -> Column:
        part = F.replace(F.replace(part, F.lit("<\\/"), F.lit("</")), F.lit("\\#"), F.lit("#"))
        return F.replace(part, F.lit("\\n"), F.lit("\n")) if line else part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _sums(values: Column) -> Column:
    """Sums before each element of a short array, and the total."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _with_starts(rows: DataFrame) -> DataFrame:
    """Add ``starts``: the running sum of ``lengths`` before each element, in linear time for long arrays.

    Each step is a column of its own, so that it is worked out once a row and not once an element.
    """
    cut = F.transform(F.sequence(F.lit(1), F.size("lengths"), F.lit(_RUN)), lambda s: F.slice("lengths", s, F.lit(_RUN)))
    rows = rows.withColumn("runs", F.transform(cut, _sums))
    rows = rows.withColumn("totals", _sums(F.transform("runs", lambda r: F.element_at(r, -1))))
    return rows.withColumn("starts", F.flatten(F.transform("runs", lambda r, k: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: x + F.get("totals", k)))))


def format_conversations(turns: DataFrame, answering: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss: the formatted text of every conversation and the spans that a loss covers.

    ``turns`` has conv_id, turn, role, text. Turns are sorted by number (nulls first), then role, then text, so ties
    have one order. Adjacent turns of one role become one block. ``loss`` is an array of (start, end) in code points of
    ``formatted``: one span per text of the role ``answering``, without marks.

    A null text or role is empty; rows with a null conv_id form one conversation; repeated rows are turns of their own.
    Other columns are ignored. An empty table gives no rows.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.struct(
        F.col("turn"), role.alias("role"), text.alias("text"), escape(role, line=True).alias("head"), escape(text).alias("body")).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def differs(k: Column, other: Column) -> Column:
        return F.get("turns", k)["role"] != F.get("turns", other)["role"]

    opens = F.transform("turns", lambda t, k: (k == 0) | differs(k, k - 1))
    marked = sorted_turns.withColumn("opens", opens)
    before = F.transform("turns", lambda t, k: F.when(F.get("opens", k), F.concat(F.lit(HEAD), t["head"], F.lit("\n"))).otherwise(F.lit(PART)))
    after = F.transform("turns", lambda t, k: F.when(F.coalesce(F.get("opens", k + 1), F.lit(True)), F.lit(END)).otherwise(F.lit("")))
    marked = marked.withColumns({"before": before, "after": after})
    pieces = F.transform("turns", lambda t, k: F.concat(F.get("before", k), t["body"], F.get("after", k)))
    marked = marked.withColumn("pieces", pieces)
    marked = _with_starts(marked.withColumn("lengths", F.transform("pieces", lambda p: F.length(p).cast("long"))))
    spans = F.transform("turns", lambda t, k: F.struct(
        (F.get("starts", k) + F.length(F.get("before", k))).alias("start"),
        (F.get("starts", k) + F.length(F.get("before", k)) + F.length(t["body"])).alias("end"), (t["role"] == answering).alias("counts")))
    loss = F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return marked.select("conv_id", F.array_join("pieces", "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_text: what the formatted texts and their loss spans hold."""
    def block(text: Column) -> Column:
        head = F.substring_index(text, "\n", 1)
        role = unescape(F.substr(head, F.lit(len(HEAD) + 1)), line=True)
        parts = F.split(F.substr(text, F.length(head) + 2), PART, -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split("formatted", END, -1)
    turns = F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))
    covered = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(covered, "").alias("loss_text"))
