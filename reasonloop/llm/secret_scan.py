"""Secret scan with DataFrame operations only: fixed patterns and a randomness test battery.

Base spans: ``assign`` (a key word, ``:`` or ``=``, a value of six or more), ``access`` (``AKIA`` and
capitals or digits, 20 or more), ``hex`` (24 or more lower-case hex digits), each kind leftmost and
non-overlapping. Positions are code points; a span ends before ``end``.

The battery adds ``random`` spans. A token is a run of 24 or more base64 characters (plain or
url-safe) that holds a letter and a digit, or of 40 or more without a digit. Its encoding is the
smallest alphabet that fits: hex, base32, base36 in either case, base64, or letters only of one or
both cases. ``- _ + /`` are symbols of base64 alone; in the other encodings they are separators and taken out,
and the symbols left must still be 24 (letters only: 40). Against "drawn uniformly from the alphabet" it is tested for
alphabet uniformity (chi-squared, Wilson-Hilferty), runs of digits, small and capital letters (too few changes) and of vowels (too many), and
lag-one serial correlation; Fisher's method joins the p-values into one statistic.

That statistic alone names no secret: a short word run can look random. A token is called a secret only where
the statistic rejects the hypothesis "written, not drawn". Its distribution under that hypothesis comes, per encoding and
length class, from ``NULL_DRAWS`` written tokens (``written``: fixed common words run together, with numbers and capitals
as the encoding allows; hex: texts and counters in hex) of the shortest length of the class, where the tests are weakest.
The Benjamini-Hochberg rule at ``ALPHA`` within each class then bounds the share of written tokens among the
added spans. As no p-value is below ``1 / (NULL_DRAWS + 1)``, a class needs at least one random token in
``ALPHA * (NULL_DRAWS + 1)`` for any to be told apart. Tokens inside a base span are not tested: they are found already. Statistics
are counted in steps of ``1 / STEPS`` decades over all texts, so the rule needs only a bounded table of
counts: two passes over the texts, nothing shuffled but counts.

A null text is empty and has no span. Ties and repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed

# the key words' first letters stand alone so that the matcher skips other places at once
ASSIGN = (r"""[pPsStTaA](?i:(?<=p)assword|(?<=p)asswd|(?<=s)ecret|(?<=t)oken|(?<=a)pi_?key)"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST = 24                # symbols of a token with a digit
SHORTEST_LETTERS = 40        # and of one without
TOKEN = (r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{%d,}|[A-Za-z+/_-]{%d,})={0,2}"
         % (SHORTEST, SHORTEST_LETTERS))
KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.01
STEPS = 50
MOST_STEPS = 15_000
NULL_DRAWS = 20_000          # written tokens per encoding and length class
LONGEST_CLASS = 18           # classes are half powers of two; 2 ** 9 symbols and more are one class

# fixed values: common words of which written tokens are made
WORDS = """
the and for with from that this have not you are was all one out who get which when make can like time just him know take
people into year good some could them see other than then now look only come over think also back after use two how our work
first well way even new want because any these give day most great where right house world school state never last city tree
user name data file list index value table server client config request response handler session account message group
image update delete create object string number window event service manager public static final default main test local
und der die das nicht mit auf ein eine ist von werden haben nach auch wird aber alles jahr zeit stadt
les des une dans pour que pas plus avec tout faire mais monde jour temps petit maison
los las una para por con como pero todo hacer tiempo casa mundo noche grande
""".split()
VOWELS = "aeiouAEIOU"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGITS = "0123456789"
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
             "base36u": _DIGITS + _UPPER, "base26": _LOWER, "base26u": _UPPER, "base52": _UPPER + _LOWER,
             "base64": _UPPER + _LOWER + _DIGITS + "+/"}


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _found(matches: Column, text: Column, pattern: str, kind: int, ok=None) -> Column:
    """array<struct<s, k, e>> of the matches: starts are running sums of the lengths of the
    pieces between matches and of the matches before."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches,
                       lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    walked = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), F.lit(kind).alias("k"),
                                                (a["at"] + x["g"] + x["m"]).alias("e")))).alias("out")))["out"]
    if ok is not None:
        walked = F.filter(walked, lambda x, i: F.element_at(ok, i + 1))
    return F.when(F.size(matches) > 0, walked).otherwise(empty)


def base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted base spans of column ``text`` (no nulls)."""
    t = F.col(text)
    staged = (df.withColumn("__v", F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)))
              .withColumn("__a", F.when(F.size("__v") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)))
                          .otherwise(F.array().cast("array<string>")))
              .withColumn("__k", F.when(t.contains("AKIA"), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)))
                          .otherwise(F.array().cast("array<string>")))
              .withColumn("__h", F.regexp_extract_all(t, F.lit(HEX), F.lit(0))))
    long_enough = F.transform("__v", lambda v: F.length(v) >= 6)
    return staged.withColumn(out, F.array_sort(F.concat(
        _found(F.col("__a"), t, ASSIGN, 0, long_enough), _found(F.col("__k"), t, ACCESS, 1),
        _found(F.col("__h"), t, HEX, 2)))).drop("__v", "__a", "__k", "__h")


def _symbols(tok: Column) -> Column:
    return F.regexp_replace(tok, "[-_+/=]", "")


def _encoding(tok: Column) -> Column:
    def of(bare: Column) -> Column:
        lower, upper, digit = (bare.rlike(c) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        n = F.length(bare)
        return (F.when(~(lower | upper), F.lit(None))
                .when(digit & lower & upper, F.lit("base64"))
                .when(n < F.when(digit, F.lit(SHORTEST)).otherwise(F.lit(SHORTEST_LETTERS)), F.lit(None))
                .when(lower & upper, F.lit("base52"))
                .when(~digit, F.when(lower, F.lit("base26")).otherwise(F.lit("base26u")))
                .when(bare.rlike("^[0-9a-f]+$") | bare.rlike("^[0-9A-F]+$"), F.lit("hex"))
                .when(bare.rlike("^[A-Z2-7]+$"), F.lit("base32"))
                .otherwise(F.when(lower, F.lit("base36")).otherwise(F.lit("base36u"))))

    return _let(_symbols(tok), of)


def _below(z: Column) -> Column:
    """Normal distribution function (logistic approximation), away from 0 and 1."""
    return _let(z, lambda z: F.least(F.lit(1.0), F.greatest(
        F.lit(1e-100), F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))))))


def _tested(tok: Column, encoding: str) -> Column:
    """The symbols of ``tok`` that are tested."""
    if encoding == "base64":
        return F.translate(F.regexp_replace(tok, "=+$", ""), "-_", "+/")
    return F.lower(_symbols(tok)) if encoding == "hex" else _symbols(tok)


def _groups(alphabet: str) -> list[tuple[str, int]]:
    """The alphabet as group marks, each with the sign that its runs test has in writing: digits, small and
    capital letters stay together (few changes), vowels and other symbols alternate (many). Groupings of one group and
    the two vowels of hex are left out."""
    case = "".join("a" if c.islower() else "A" if c.isupper() else "0" for c in alphabet)
    vowel = "".join("V" if c in VOWELS else "C" for c in alphabet)
    return [(g, sign) for g, sign in ((case, -1),) + (((vowel, 1),) if len(alphabet) > 16 else ()) if len(set(g)) > 1]


def _runs(s: Column, n: Column, alphabet: str, marks: str) -> Column:
    """z-value of the number of places where a symbol's group differs from the next one's, against
    its mean and variance for uniform symbols."""
    share = [marks.count(m) / len(marks) for m in sorted(set(marks))]
    q = 1 - sum(p * p for p in share)
    both = sum(p * (1 - p) ** 2 for p in share)
    changes = F.length(F.regexp_replace(F.translate(s, alphabet, marks), r"(.)\1+", "$1")) - 1
    return (changes - (n - 1) * q) / F.sqrt((n - 1) * (q * (1 - q)) + (n - 2) * (2 * (both - q * q)))


def battery(tok: Column, encoding: str) -> Column:
    """Fisher-combined p-value of ``tok`` being uniform over the encoding's alphabet."""
    alphabet = ALPHABETS[encoding]
    k = len(alphabet)
    groups = _groups(alphabet)

    def tests(s: Column) -> Column:
        n = F.length(s).cast("double")
        squares = F.aggregate(F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0),
                              lambda a, c: a + F.pow(n - F.length(F.replace(s, c)), F.lit(2.0)))
        chi = F.lit(float(k)) / n * squares - n
        df = F.lit(k - 1.0) * n / (n - 1)
        z1 = (F.pow(F.greatest(chi, F.lit(0.0)) / F.lit(k - 1.0), F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) \
            / F.sqrt(F.lit(2.0) / (9 * df))
        places = F.transform(F.filter(F.split(s, ""), lambda c: c != ""),
                             lambda c: F.position(c, F.lit(alphabet)).cast("double") - F.lit((k + 1) / 2))
        products = _let(places, lambda x: F.aggregate(
            F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x)), lambda a, b: a * b),
            F.lit(0.0), lambda a, v: a + v))
        z3 = products / (F.sqrt(n - 1) * F.lit((k * k - 1) / 12))
        two = lambda z: F.least(F.lit(1.0), 2 * _below(-F.abs(z)))
        half = -(F.log(_below(-z1)) + F.log(two(z3)))
        for marks, sign in groups:
            half = half - F.log(_below(-sign * _runs(s, n, alphabet, marks)))

        def survival(v: Column) -> Column:
            series = term = F.lit(1.0)
            for i in range(1, 2 + len(groups)):
                term = term * v / i
                series = series + term
            return F.least(F.lit(1.0), F.exp(-v) * series)

        return _let(half, survival)

    return _let(_tested(tok, encoding), tests)


def _class(encoding: Column, symbols: Column) -> Column:
    size = F.least(F.floor(F.log2(symbols.cast("double")) * 2).cast("int"), F.lit(LONGEST_CLASS))
    return F.concat_ws(":", encoding, size.cast("string"))


def _step(p: Column) -> Column:
    return F.least(F.lit(MOST_STEPS), F.floor(-F.log10(F.greatest(p, F.lit(1e-290))) * STEPS).cast("int"))


def _shortest(cls: str) -> int:
    """The fewest symbols of a token of the class."""
    encoding, size = cls.split(":")
    return max(SHORTEST if encoding in ("hex", "base32", "base36", "base36u", "base64") else SHORTEST_LETTERS,
               math.ceil(2 ** (int(size) / 2)))


def written(i: Column, cls: str) -> Column:
    """The ``i``-th written token of a class, its choices drawn from a hash of class and ``i``."""
    encoding, n = cls.split(":")[0], _shortest(cls)
    words = F.array(*[F.lit(w) for w in WORDS])

    def draw(j: Column, use: str, among: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{cls}:{use}"), i, j), F.lit(among)).cast("int")

    def piece(j: Column) -> Column:
        word = F.element_at(words, draw(j, "word", len(WORDS)) + 1)
        number = F.substr(F.lpad(draw(j, "number", 10_000).cast("string"), 4, "0"), F.lit(1), draw(j, "digits", 4) + 1)
        if encoding in ("base26u", "base32", "base36u"):
            word = F.upper(word)
        elif encoding in ("base52", "base64"):     # capitals at every word and no separators: what looks most random
            word = F.initcap(word)
        if encoding == "base32":
            number = F.translate(number, "0189", "2345")
        # every written token of an encoding with digits has some
        return word if encoding.startswith("base26") or encoding == "base52" else \
            F.when((j == 1) | (draw(j, "kind", 12) <= draw(F.lit(0), "numbers", 5)), number).otherwise(word)

    if encoding == "hex":
        text = F.lower(F.hex(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n // 2)), lambda j: F.element_at(
            words, draw(j, "word", len(WORDS)) + 1))).cast("binary")))
        counter = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(n // 8 + 1)), lambda j: F.lpad(
            F.lower(F.hex(draw(j, "number", 4096))), 8, "0")))
        return F.substr(F.when(draw(F.lit(0), "form", 2) == 0, text).otherwise(counter), F.lit(1), F.lit(n))
    run = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(n)), piece))
    return F.substr(run, draw(F.lit(0), "from", 3) + 1, F.lit(n))


def candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<struct<s, e, cls, step>> of the tokens the battery was run on; ``cls`` is
    the encoding and length class, ``step`` the p-value in steps of 1 / STEPS decades."""
    t = F.col(text)
    staged = df.withColumn("__t", F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)))
    staged = staged.withColumn("__p", _found(F.col("__t"), t, TOKEN, 3))
    staged = staged.withColumn("__c", F.when(F.size("__t") > 0, F.filter(
        F.zip_with("__t", "__p", lambda x, p: F.struct(p["s"].alias("s"), p["e"].alias("e"), x.alias("tok"),
                                                       _encoding(x).alias("enc"))),
        lambda x: x["enc"].isNotNull())))

    def judged(x: Column) -> Column:
        p = F.when(x["enc"] == "hex", battery(x["tok"], "hex"))
        for name in [e for e in ALPHABETS if e != "hex"]:
            p = p.when(x["enc"] == name, battery(x["tok"], name))
        symbols = F.length(F.when(x["enc"] == "base64", _tested(x["tok"], "base64")).otherwise(_symbols(x["tok"])))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), _class(x["enc"], symbols).alias("cls"), _step(p).alias("step"))

    none = F.array().cast("array<struct<s:int,e:int,cls:string,step:int>>")
    return staged.withColumn(out, F.coalesce(F.transform("__c", judged), none)).drop("__t", "__p", "__c")


def _outside(base: str):
    return lambda x: ~F.exists(base, lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))


def null_steps(spark: SparkSession, classes: list[str], draws: int = NULL_DRAWS) -> DataFrame:
    """(cls, step, n): the statistic's distribution over the written tokens of the classes."""
    parts = [spark.range(draws).select(F.lit(cls).alias("cls"), _step(battery(written(F.col("id"), cls), cls.split(":")[0]))
                                       .alias("step")) for cls in classes]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("cls", "step").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> dict[str, int]:
    """Class -> the last step at which the Benjamini-Hochberg rule rejects "written"; a class in which
    it rejects nothing has no entry. At most one row per encoding and length class returns."""
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = candidates(base_spans(src.where(F.col("t").rlike(TOKEN)), "t", "base"), "t", "c")
    counts = materialize(found.select(F.explode(F.filter("c", _outside("base"))).alias("c"))
                         .groupBy("c.cls", "c.step").agg(F.count(F.lit(1)).alias("n")), "secret-steps")
    classes = sorted(r.cls for r in counts.select("cls").distinct().collect())
    if not classes:
        return {}
    both = (counts.withColumn("w", F.lit(0).cast("long"))
            .unionByName(null_steps(docs.sparkSession, classes).select("cls", "step", F.lit(0).cast("long").alias("n"), F.col("n").alias("w")))
            .groupBy("cls", "step").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    up = Window.partitionBy("cls").orderBy("step")       # at most MOST_STEPS + 1 rows per class
    ranked = both.select("cls", "step", "n", F.sum("n").over(up).alias("rank"),
                         ((F.sum("w").over(up) + 1) / F.lit(NULL_DRAWS + 1.0)).alias("p"),
                         F.sum("n").over(Window.partitionBy("cls")).alias("m"))
    hit = ranked.where((F.col("n") > 0) & (F.col("m") * F.col("p") <= F.lit(alpha) * F.col("rank")))
    return {r.cls: r.step for r in hit.groupBy("cls").agg(F.max("step").alias("step")).collect()}


def with_spans(docs: DataFrame, text: str, cut: dict[str, int], base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds the base spans and all spans (sorted arrays of start, kind, end) of a null-free column."""
    if not cut:
        df = base_spans(docs, text, base)
        return df.withColumn(spans, F.col(base))
    df = candidates(base_spans(docs, text, base), text, "__cand")

    def looks_random(x: Column) -> Column:
        limit = F.lit(-1)
        for cls, step in sorted(cut.items()):
            limit = F.when(x["cls"] == cls, F.lit(step)).otherwise(limit)
        return (x["step"] <= limit) & _outside(base)(x)

    random = F.transform(F.filter("__cand", looks_random),
                         lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return df.withColumn(spans, F.array_sort(F.concat(F.col(base), random))).drop("__cand")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Per row: id, ``n_assign, n_access, n_hex, n_random``, ``base_sha256`` and ``spans``."""
    cut = cutoffs(docs, text_col, alpha)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = with_spans(src, "t", cut).drop("t")

    def of_kind(i: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    n = [of_kind(i) for i in range(len(KINDS))]
    return df.select(F.col("id").alias(id_col), *n[:3], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                     joined(F.col("spans")).alias("spans"), n[3])


def redact(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (spans that overlap become one mask); rows
    and columns stay, null texts stay null."""
    cut = cutoffs(docs, text_col, alpha)
    row, t = F.col("row"), F.col("t")
    plain = row.getField(text_col).cast("string")
    df = with_spans(packed(docs).withColumn("t", F.coalesce(plain, F.lit(""))), "t", cut)

    def step(a: Column, x: Column) -> Column:
        return (F.when(x["s"] >= a["at"], F.struct(
                    F.concat(a["out"], F.substr(t, a["at"] + 1, x["s"] - a["at"]), F.lit(mask)).alias("out"), x["e"].alias("at")))
                .otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at"))))

    masked = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                         lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1, F.length(t))))
    return (df.withColumn("masked", F.when(F.size("spans") > 0, masked).otherwise(plain))
            .select(*[(F.col("masked") if c == text_col else row.getField(c)).alias(c) for c in docs.columns]))
