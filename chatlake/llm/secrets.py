"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

A candidate is a run of 20 or more characters of the usual encodings. Its encoding is inferred from the characters it has. Under
"random", its symbols are uniform (chi-squared), their upper and lower halves alternate at random (runs) and neighbours are
uncorrelated (lag 1); a candidate that fails one of the three is no secret. Under "word-like", the chi-squared value is
noncentral and grows with the length; its lower tail is the p-value of a discovery. A hex token must differ from two kinds of
runs: words of its six letters, and numbers with stray letters. Digits alone have an alphabet of their own, in which a number is as
even as a secret, so they are hardly ever discoveries. Benjamini and Hochberg's rule, within bands of length, over all documents,
bounds the share of false discoveries.

Null and empty texts have no spans. Rows are judged one by one, repeated or not; the rule counts repeats. An empty table gives no
rows. Offsets are code points, ends exclusive. Columns other than the text are never read; ``redacted`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.binding import fold, let
from chatlake.llm.common import computed, read
from chatlake.llm.registry import query
from chatlake.session import materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest accepted length is part of the pattern where a run's start decides whether it is accepted.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")
#: Alphabets in the order they are tried: name, pattern, symbols.
ALPHABETS = (
    ("digits", r"^[0-9]+$", 10), ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16), ("lower", r"^[a-z]+$", 26), ("upper", r"^[A-Z]+$", 26),
    ("base32", r"^[A-Z2-7]+=*$", 32), ("lower36", r"^[a-z0-9]+$", 36), ("upper36", r"^[A-Z0-9]+$", 36),
    ("alnum", r"^[A-Za-z0-9]+$", 62), ("base64", r"", 64),
)
#: Chance that two characters of a word-like text are equal: any letters, and by size of the alphabet where it holds few of them
#: (numbers have even digits; a to f keep their frequencies in text).
TEXT_COINCIDENCE = 0.066
COINCIDENCE = {10: 0.1, 16: 0.26}
#: Share of letters in a hex-like run that is a number.
STRAY_LETTERS = 0.03
RANDOM_LEVEL = 0.01
FALSE_SHARE = 0.01
BANDS = (32, 48, 64, 128)
#: p-values are counted in bins of a quarter decade, the last open.
BINS_PER_DECADE, BINS = 4, 80


def spans(text: Column, found: Column, pattern: str, values: Column | None = None) -> Column:
    """(start, end) of the leftmost non-overlapping matches: the text between matches and the matches add up to the places.

    With ``values`` (group 2, the end of each match), matches with a shorter value than ``MIN_VALUE`` are left out.
    """
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"),
                         (found if values is None else values).alias("value"))
    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(F.array(F.struct(begin.alias("start"), end.alias("end"), F.length(x["value"]).alias("value"))).alias("done"), end.alias("pos"))

    every = fold(parts, {"pos": F.lit(0)}, "STRUCT<start: INT, end: INT, value: INT>", step, lambda done, acc: done)
    kept = every if values is None else F.filter(every, lambda x: x["value"] >= MIN_VALUE)
    return F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(
        F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by its logistic approximation (within 2e-4)."""
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return 1 / (1 + F.exp(-1.5976 * bounded - 0.070566 * bounded * bounded * bounded))


def number_like(letters: Column, n: Column) -> Column:
    """Chernoff's bound of the chance that a number of ``n`` characters has so many stray letters."""
    share, rest = letters / n, (n - letters) / n
    part = lambda x, of: F.when(x > 0, x * F.log(F.greatest(x, F.lit(1e-9)) / of)).otherwise(0.0)
    return F.when(share <= STRAY_LETTERS, 1.0).otherwise(F.exp(-n * (part(share, STRAY_LETTERS) + part(rest, 1 - STRAY_LETTERS))))


def battery(token: Column) -> Column:
    """Struct of ``n``, ``p_random`` (the smallest of the three tests, times three) and ``p_word`` for a token."""
    body = F.rtrim(token, F.lit("="))
    k = F.lit(float(ALPHABETS[-1][2]))
    for _, pattern, size in reversed(ALPHABETS[:-1]):
        k = F.when(body.rlike(pattern), F.lit(float(size))).otherwise(k)

    def tests(x: Column) -> Column:
        codes, chars, k, n = x["codes"], x["chars"], x["k"], x["n"]
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(
            F.size(F.filter(chars, lambda y: y == c)).cast("double"), F.lit(2.0)))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n
        pairs = F.slice(F.arrays_zip(codes.alias("a"), F.slice(codes, 2, F.size(codes)).alias("b")), 1, F.size(codes) - 1)

        def last(y: Column) -> Column:
            m, chi = y["m"], k / n * y["sq"] - n
            dev = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c - m) * (c - m))
            co = F.aggregate(y["pairs"], F.lit(0.0), lambda acc, p: acc + (p["a"] - m) * (p["b"] - m))
            changes = F.aggregate(y["pairs"], F.lit(0.0), lambda acc, p: acc + ((p["a"] > m) != (p["b"] > m)).cast("double"))
            high = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c > m).cast("double"))

            def combined(v: Column) -> Column:
                df = k - 1
                z_chi = (F.pow(F.greatest(v["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
                mu = 2 * v["high"] * (n - v["high"]) / n + 1
                var = (mu - 1) * (mu - 2) / (n - 1)
                z_runs = F.when(var > 1e-9, (v["changes"] + 1 - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(30.0)
                z_serial = F.when(v["dev"] > 1e-9, v["co"] / F.greatest(v["dev"], F.lit(1e-9)) * F.sqrt(n)).otherwise(30.0)
                rate = F.lit(TEXT_COINCIDENCE)
                for size, own in COINCIDENCE.items():
                    rate = F.when(k == size, F.lit(own)).otherwise(rate)
                shift = n * (k * rate - 1)
                even = normal_cdf((v["chi"] - df - shift) / F.sqrt(2 * df + 4 * shift))
                word = F.when(k == 16, F.greatest(even, x["number"])).otherwise(even)
                worst = F.least(1 - normal_cdf(z_chi), 2 * normal_cdf(-F.abs(z_runs)), 2 * normal_cdf(-F.abs(z_serial)))
                return F.struct(n.cast("int").alias("n"), F.least(F.lit(1.0), 3 * worst).alias("p_random"), word.alias("p_word"))

            return let(F.struct(chi.alias("chi"), dev.alias("dev"), co.alias("co"), changes.alias("changes"), high.alias("high")), combined)

        return let(F.struct(mean.alias("m"), squares.alias("sq"), pairs.alias("pairs")), last)

    chars, n = F.split(body, ""), F.length(body).cast("double")
    letters = F.length(F.translate(body, "0123456789", "")).cast("double")
    return let(F.struct(number_like(letters, n).alias("number"), chars.alias("chars"), F.transform(chars, lambda c: F.ascii(c).cast("double")).alias("codes"),
                        k.alias("k"), n.alias("n")), tests)


def band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, edge in reversed(list(enumerate(BANDS))):
        out = F.when(n < edge, F.lit(i)).otherwise(out)
    return out


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")


def scanned(docs: DataFrame) -> DataFrame:
    """The rows with ``_base`` (spans of the patterns) and ``_cands`` (spans that pass as random, with their band and bin)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = computed(docs, _text=text, **{f"_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0))
                                         for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM), strict=True)})
    t = F.col("_text")
    values = F.when(F.size("_assign") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)))
    found = computed(hits, _a=spans(t, F.col("_assign"), ASSIGN, values), _k=spans(t, F.col("_access"), ACCESS),
                     _h=spans(t, F.col("_hex"), HEX), _r=spans(t, F.col("_random"), RANDOM))
    tag = lambda column, kind: F.transform(column, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))
    tried = computed(found, _b=F.zip_with("_random", "_r", lambda token, x: F.struct(x.alias("span"), battery(token).alias("b"))))
    cands = F.transform(F.filter("_b", lambda x: x["b"]["p_random"] >= RANDOM_LEVEL), lambda x: F.struct(
        x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), band(x["b"]["n"]).alias("band"), bin_of(x["b"]["p_word"]).alias("bin")))
    # The rule needs all tokens that were tried, those that fail as random included: they count with a p-value of 1.
    done = computed(tried, _base=F.array_sort(F.concat(tag(F.col("_a"), "assign"), tag(F.col("_k"), "access"), tag(F.col("_h"), "hex"))),
                    _cands=cands, _tried=F.transform("_b", lambda x: band(x["b"]["n"])))
    return done.select(*docs.columns, "_base", "_cands", "_tried")


def thresholds(rows: DataFrame, share: float = FALSE_SHARE) -> list[int]:
    """Per band of length, the lowest bin whose tokens are discoveries; above all bins where there are none.

    The counts have (bands x bins) rows at most, whatever the input; nothing else reaches the driver.
    """
    tried = dict(rows.select(F.explode("_tried").alias("band")).groupBy("band").count().collect())
    counts: dict[int, list[int]] = {b: [0] * (BINS + 1) for b in range(len(BANDS) + 1)}
    for b, i, n in rows.select(F.explode("_cands").alias("c")).groupBy("c.band", "c.bin").count().collect():
        counts[b][i] += n
    out = []
    for b, bins in counts.items():
        lowest = BINS + 1
        for i in range(BINS + 1):
            found = sum(bins[i:])
            if found and 10 ** (-i / BINS_PER_DECADE) * tried.get(b, 0) <= share * found:
                lowest = i
                break
        out.append(lowest)
    return out


def decided(rows: DataFrame, limits: list[int]) -> DataFrame:
    """``_spans``: the base spans and those of discoveries, by start, kind and end."""
    limit = F.array(*[F.lit(x) for x in limits])
    added = F.transform(F.filter("_cands", lambda x: x["bin"] >= F.get(limit, x["band"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", added)))


def listed(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"),
                                                                  x["end"].cast("string"))), ",")


#: Characters of the blocks in which pieces of a text are found.
PIECE_BLOCK = 4096


def without(text: Column, found: Column, mark: str) -> Column:
    """``text`` with ``mark`` in the place of each span (by start); overlapping spans are replaced together.

    The text is cut into blocks once, so a piece between two spans is found without walking there from the text's start.
    """
    def gap(acc: Column, x: Column) -> Column:
        piece = F.struct(acc["pos"].alias("from"), x["start"].alias("to"))
        none = F.array().cast("array<struct<from:int,to:int>>")
        return F.struct(F.when(x["start"] >= acc["pos"], F.array(piece)).otherwise(none).alias("done"), F.greatest(acc["pos"], x["end"]).alias("pos"))

    gaps = fold(found, {"pos": F.lit(0)}, "STRUCT<from: INT, to: INT>", gap,
                lambda done, acc: F.concat(done, F.array(F.struct(acc["pos"].alias("from"), F.length(text).alias("to")))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_BLOCK}}}"), F.lit(0))

    def pieces(b: Column) -> Column:
        def piece(g: Column) -> Column:
            first, last = F.floor(g["from"] / PIECE_BLOCK).cast("int"), F.floor(g["to"] / PIECE_BLOCK).cast("int")
            begin, end = g["from"] - first * PIECE_BLOCK, g["to"] - last * PIECE_BLOCK
            block = lambda i: F.coalesce(F.get(b, i), F.lit(""))
            across = F.concat(F.substring(block(first), begin + 1, F.lit(PIECE_BLOCK)), F.array_join(F.slice(b, first + 2, F.greatest(F.lit(0), last - first - 1)), ""),
                              F.substring(block(last), F.lit(1), end))
            return F.when(first == last, F.substring(block(first), begin + 1, end - begin)).otherwise(across)

        return let(gaps, lambda all_gaps: F.array_join(F.transform(all_gaps, piece), mark))

    return let(blocks, pieces)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``mark``; overlapping spans are replaced together. Each text is scanned once: the
    documents are written with their spans before thresholds are set, which moves no text between tasks. ``n_chars`` is counted
    anew if present."""
    rows = materialise(scanned(docs.select(F.struct("*").alias("_doc"), "text")).drop("text"), "secret-rows")
    rows = decided(rows, thresholds(rows)).withColumn("text", F.col("_doc.text"))
    clean = F.when(F.size("_spans") > 0, without(F.col("text"), F.col("_spans"), mark)).otherwise(F.col("text"))
    doc = F.col("_doc").withField("text", F.col("_clean"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("_clean").cast(docs.schema["n_chars"].dataType))
    # Evaluated once per row, not once for the text and once for its length.
    return computed(rows, _clean=clean).select(doc.alias("_doc")).select("_doc.*")


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(scanned(read(spark, folder, "documents").select("doc_id", "text")).drop("text"), "secrets")
    of_kind = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return decided(rows, thresholds(rows)).select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed("_base").cast("binary"), 256).alias("base_sha256"), listed("_spans").alias("spans"))
