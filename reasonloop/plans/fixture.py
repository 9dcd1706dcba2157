"""Problem / candidate / log tables derived from the driver's star-schema tables.

The driver's text tables hold no math, so the workload's tables are derived by rule:

* problem = order: ``answer = 'Order has parts. #### ' || gold`` where gold is the largest
  line quantity of the order (0 when the order has no line);
* candidate = line item: ``cand_idx`` numbers the lines of an order by
  ``l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate``; the text has one of
  five shapes chosen by ``(cand_idx + shift) % 5`` (``shift`` gives a second,
  "rationalised" candidate set);
* conversation pairs: a user turn and the assistant turn that follows it;
* loss log: events as per-batch losses (run = user, phase by event type, epoch = day,
  error events are skipped batches with no loss);
* token arrays: integer arrays cut from line-item keys.

Every table grows with its source table; nothing here is a fixed or synthetic input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genstore import prompt_key
from ..operators.ordinal import group_row_number, largest_group
from ..operators.skew import block_join, block_rows
from ..session import materialize

CANDIDATE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


# ---------------------------------------------------------------------------
# The prompts that the recorded generations were asked with, as they were sent.
# Each is the text before and after the question (for the hinted one: gold, then question).
# ---------------------------------------------------------------------------
RECORDED_VARIANTS = {
    "variant_1": ("Q: ", "\nLet's think step by step.\nA:"),
    "variant_2": ("Q: ", "\nLet's think step by step.\nA:\n(Please finish with a final line starting with \"Final answer:\" "
                         "followed by the numeric answer.)"),
    "variant_3": ("Q: ", "\nLet's think step by step.\nA:\n(Show your steps and then on the last line write EXACTLY: "
                         "Final answer: <number>)"),
}
RECORDED_HINTED = (
    "# Rationalize with hint: show steps that arrive at the given correct final.\n"
    "You are a helpful math tutor. The correct final answer is ",
    ".\nExplain step by step how to arrive at that answer for the problem below.\n"
    "Return the same final numeric answer after \"#### \".\n\nQ: ",
    "\nA:\n",
)
RECORDED_SETTINGS = {"max_new_tokens": 160, "do_sample": False}
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, gold``: the largest line quantity per order (partial aggregate)."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.max("l_quantity").cast("bigint").alias("gold")))


def problems_from_orders(orders: DataFrame, gold: DataFrame) -> DataFrame:
    """Problems for a set of orders (a table or one micro-batch of a stream)."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    j = orders.join(gold, orders.o_orderkey == gold.l_orderkey, "left")
    g = F.coalesce(F.col("gold"), F.lit(0).cast("bigint"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "),
                 F.col("o_custkey").cast("string"), F.lit(" has priority "),
                 F.col("o_orderpriority"),
                 F.lit(". What is the largest quantity on one of its lines?")).alias("question"),
        F.concat(F.lit("Order has parts. #### "), g.cast("string")).alias("answer"),
        g.alias("gold"),
    )


def candidate_text(idx, q, shift: int = 0):
    """The five candidate shapes, keyed by ``(idx + shift) % 5``."""
    qs = q.cast("string")
    shape = (idx + F.lit(shift)) % 5
    return (F.when(shape == 0, F.concat(F.lit("step = "), qs, F.lit(" so #### "), qs))
            .when(shape == 1, F.concat(F.lit("#### "), qs, F.lit(" units")))
            .when(shape == 2, F.concat(F.lit("Final answer: $"), qs))
            .when(shape == 3, F.lit("no number here"))
            .otherwise(F.concat(F.lit("12 = "), qs, F.lit(" then #### 1,"), qs)))


def numbered_lines(spark: SparkSession, sf_dir: str, largest: int | None = None) -> DataFrame:
    """Line items with their 1-based ``cand_idx`` inside the order (``largest``: lines of the largest order, if known)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", *CANDIDATE_ORDER)
    return group_row_number(li, ["l_orderkey"], CANDIDATE_ORDER, name="cand_idx", largest=largest)


def candidates(spark: SparkSession, sf_dir: str, shift: int = 0,
               lines: DataFrame | None = None) -> DataFrame:
    """``id bigint, cand_idx int, text string`` — one row per line item."""
    nl = lines if lines is not None else numbered_lines(spark, sf_dir)
    return nl.select(
        F.col("l_orderkey").alias("id"),
        F.col("cand_idx"),
        candidate_text(F.col("cand_idx"), F.col("l_quantity").cast("bigint"), shift).alias("text"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, question, generated``: each user turn joined to the assistant turn
    right after it. An equi-join on (conv_id, turn) spreads even one huge conversation over
    many tasks, which a window partitioned by conv_id would not."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn"), F.col("text").alias("question"))
    bot = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated"))
    return user.join(bot, ["conv_id", "turn"])


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run bigint, phase string, epoch int, step bigint, loss double`` from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run"),
        F.when(F.col("event_type").isin("view", "purchase"), F.lit("val"))
         .otherwise(F.lit("train")).alias("phase"),
        F.unix_date(F.to_date("ts")).alias("epoch"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
         .otherwise(F.col("value") / 100.0).alias("loss"),
    )


def token_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, prompt_ids array<int>,
    target_ids array<int>``: a prompt of 1-3 ids and a target of ``l_quantity`` ids per line
    item (the first five columns order the examples)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    n_prompt = (F.col("l_partkey") % 3 + 1).cast("int")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.slice(F.array(F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"),
                        F.col("l_linenumber")), F.lit(1), n_prompt).alias("prompt_ids"),
        F.sequence(F.lit(1), F.col("l_quantity").cast("int")).alias("target_ids"),
    )


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, line, part, supp, text, gold``: per line item a text with one of the cues, signs, separators
    and empty forms that answers come in, and a gold that may be null, empty or without a mark."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n = F.col("l_quantity").cast("bigint").cast("string")

    def around(before: str, after: str = ""):
        return F.concat(F.lit(before), n, F.lit(after))

    texts = [around("So the final answer is -"), around("The ANSWER: +", ".50"), around("a => ", "."),
             around("the result is ", ".0 apples"), around("Result: $", ",500.00"), around("#### -1,"),
             around("  ", "  "), F.lit("nothing here\nlast line words"), F.lit(""), F.lit(None).cast("string"),
             around("final answer: 7 but x = ", ".75")]
    golds = [around("#### "), F.lit(None).cast("string"), F.lit(""), around("cost #### $"), around("-", ".0"),
             around("The answer is ", ".5 or #### 1,")]
    pick = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(texts))).cast("int")
    gold = F.pmod(F.col("l_partkey"), F.lit(len(golds))).cast("int")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                     F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
                     F.get(F.array(*texts), pick).alias("text"), F.get(F.array(*golds), gold).alias("gold"))


def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of files that name their fields differently: of every alias chain the first names are
    null or empty in some rows, and one name is in no row at all."""
    li = table(spark, sf_dir, "lineitem")
    pick = F.pmod(F.col("l_orderkey") + F.col("l_partkey"), F.lit(5))
    n = F.col("l_quantity").cast("bigint").cast("string")

    def held(*when: int, text=n):
        """The value in some rows, empty in others, else null."""
        return F.when(pick.isin(*when), text).when(pick == (when[0] + 1) % 5, F.lit(""))

    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), held(0).alias("gold"), held(1, text=F.concat(F.lit("#### "), n)).alias("answer"),
        held(2, 3).alias("gold_answer"), held(3).alias("answer_text"), F.when(pick == 4, n).alias("A"),
        held(1, 2, text=F.concat(F.lit("so "), n)).alias("generated"), held(2, text=F.lit("how many")).alias("question"),
        held(4, text=F.lit("count")).alias("q"), held(0, 3, text=F.lit("steps")).alias("solution"))


def texts_of(lines: DataFrame, shift: int = 0) -> DataFrame:
    """``id, cand_idx, text`` of numbered lines (``id, q, cand_idx``) with the shapes shifted by ``shift``."""
    return lines.select("id", "cand_idx", candidate_text(F.col("cand_idx"), F.col("q"), shift).alias("text"))


class Tables:
    """The fixture tables of one query, each computed once and written under the shared
    checkpoint folder: every branch of the query reads the same table instead of re-running
    its plan, and the lineage is cut at the table.

    The tables are plain Parquet, not bucketed by id: a bucket is read by one task, so a
    problem holding a third of all candidates would put a third of the scoring into one
    task. Plain files split evenly by size; joins on id are then broadcast (when measured
    small) or shuffled on both sides, where adaptive execution splits a hot partition."""

    def __init__(self, spark: SparkSession, sf_dir: str, shared_lines: bool = True):
        """``shared_lines``: write the numbered line items (for queries that read the candidates
        more than once, as picks and joins do); otherwise they stay a lazy plan
        (unless an order has more than a block of lines: joins by blocks read them more than once)."""
        self.spark, self.sf_dir, self.shared_lines = spark, sf_dir, shared_lines
        self._problems: DataFrame | None = None
        self._lines: DataFrame | None = None
        self._largest: int | None = None

    @property
    def largest_order(self) -> int:
        """Lines of the largest order, which no ``cand_idx`` exceeds."""
        if self._largest is None:
            self._largest = largest_group(table(self.spark, self.sf_dir, "lineitem"), ["l_orderkey"])
        return self._largest

    @property
    def problems_once(self) -> DataFrame:
        """``id, question, answer, gold`` as a lazy plan, for queries that read it once."""
        return problems_from_orders(table(self.spark, self.sf_dir, "orders"), order_golds(self.spark, self.sf_dir))

    @property
    def problem_ids(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "orders").select(F.col("o_orderkey").alias("id"))

    @property
    def problems(self) -> DataFrame:
        if self._problems is None:
            self._problems = materialize(self.problems_once, "problems")
        return self._problems

    @property
    def lines(self) -> DataFrame:
        """``id, q, cand_idx``: line items numbered inside their order."""
        if self._lines is None:
            nl = numbered_lines(self.spark, self.sf_dir, self.largest_order).select(
                F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("bigint").alias("q"), "cand_idx")
            written = self.shared_lines or self.largest_order >= block_rows(self.spark)
            self._lines = materialize(nl, "lines") if written else nl
        return self._lines

    def candidates(self, shift: int = 0) -> DataFrame:
        """``id, cand_idx, text`` with the shapes shifted by ``shift``."""
        return texts_of(self.lines, shift)

    def recorded_variants(self) -> DataFrame:
        """``prompt_key, cand_idx, text``: variant i of a problem was answered by its candidates i, i + 3, i + 6 ..."""
        keys = self.problems.select("id", F.array(*[prompt_key(F.concat(F.lit(a), "question", F.lit(b)), RECORDED_SETTINGS)
                                                    for a, b in RECORDED_VARIANTS.values()]).alias("keys"))
        nth = F.pmod(F.col("cand_idx") - 1, F.lit(len(RECORDED_VARIANTS)))
        both = block_join(self.candidates(), keys, "id", highest=self.largest_order)
        return both.select(F.get("keys", nth).alias("prompt_key"), "cand_idx", "text")

    def recorded_hinted(self, shift: int) -> DataFrame:
        """``prompt_key, cand_idx, text``: the hinted prompt of a problem was answered by its shifted candidates."""
        a, b, c = RECORDED_HINTED
        prompt = F.concat(F.lit(a), F.col("gold").cast("string"), F.lit(b), "question", F.lit(c))
        keys = self.problems.select("id", prompt_key(prompt, RECORDED_SETTINGS).alias("prompt_key"))
        return block_join(self.candidates(shift), keys, "id", highest=self.largest_order).select("prompt_key", "cand_idx", "text")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, question``: the user turns of the conversations, which may repeat."""
    conv = table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & F.col("text").isNotNull())
    return conv.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("question"))


class StepGenerator:
    """A callable generator for tests and queries: text j of a prompt tells its length times j. ``stop_at``: the
    prompts whose key lies in this unit of ``units`` or a later one raise, as a lost model server would."""

    def __init__(self, settings: dict, units: int = 1, stop_at: int | None = None):
        self.settings, self.units, self.stop_at = settings, units, stop_at

    def __call__(self, prompts: list[str], k: int) -> list[list[str]]:
        import hashlib
        import json
        head = json.dumps(self.settings, sort_keys=True) + "\n"
        if self.stop_at is not None:
            for p in prompts:
                if int(hashlib.md5((head + p).encode()).hexdigest()[:8], 16) % self.units >= self.stop_at:
                    raise ConnectionError("generator stopped halfway")
        return [[f"attempt {j}: #### {len(p) * j}" for j in range(1, k + 1)] for p in prompts]
