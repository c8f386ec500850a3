"""Assembling dialogue context.

``messages`` rows are (conv_id, turn, role, text). Conversations of any length are processed in blocks of
turns (see `segments`), never as one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import risk as R
from chatlake.functions.lexicon import DEFAULT, Lexicon
from chatlake.functions.text import WS_CHARS, estimate_tokens, squeeze, strip
from chatlake.operators.risk import score
from chatlake.operators.segments import numbered, previous, surroundings, top_n, trailing, turn_segment

# Restore and budget sizes.
RESTORE_EXCHANGES = 40
HISTORY_SCAN = 200
SESSION_BUDGET = 600_000
SESSION_MESSAGES = 100


def role_class(role: Column, text: Column) -> Column:
    """Dialogue / summary / blank_summary / preserved."""
    return (
        F.when(role.isin("user", "assistant"), "dialogue")
        .when((role == "system_summary") & (F.coalesce(strip(text), F.lit("")) == ""), "blank_summary")
        .when(role == "system_summary", "summary").otherwise("preserved")
    )


def dialogue(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin("user", "assistant"))


def exchanges(messages: DataFrame) -> DataFrame:
    """An assistant row directly after a user row of the dialogue is an exchange."""
    rows = previous(dialogue(messages), ["conv_id"], turn_segment(), ["turn"], {"role": "__role", "text": "__text"})
    return rows.where((F.col("role") == "assistant") & (F.col("__role") == "user")).select(
        "conv_id", "turn", F.col("__text").alias("user_message"), F.col("text").alias("bot_response"))


def unpaired(messages: DataFrame) -> DataFrame:
    """Dialogue rows that pass through - users without a reply, assistants without a question."""
    rows = surroundings(dialogue(messages), ["conv_id"], turn_segment(), ["turn"], before={"role": "__before"}, after={"role": "__after"})
    before, after = F.coalesce("__before", F.lit("")), F.coalesce("__after", F.lit(""))
    lone = ((F.col("role") == "user") & (after != "assistant")) | ((F.col("role") == "assistant") & (before != "user"))
    return rows.where(lone).drop("__before", "__after")


def session_tokens(messages: DataFrame) -> DataFrame:
    """Estimated prompt size per conversation with role overheads and a five per cent margin."""
    each = estimate_tokens(F.coalesce("text", F.lit(""))) + 4 + F.when(F.col("role") == "system", 2).otherwise(0)
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        ((F.sum(each) + 4) * F.lit(1.05)).cast("bigint").alias("session_tokens"),
    )


def session_state(messages: DataFrame, *, budget: int = SESSION_BUDGET, keep: int = SESSION_MESSAGES,
                  warn: float = 0.70) -> DataFrame:
    """Newest messages kept, their token total, its share of the budget and a warning."""
    kept = top_n(messages, ["conv_id"], [F.col("turn").desc()], keep)
    share = F.col("session_tokens") / F.lit(budget)
    return session_tokens(kept).withColumn("budget_share", share).withColumn(
        "warning", F.col("session_tokens") > F.lit(budget * warn))


def token_budget(activity: DataFrame, max_tokens: int, *, order: str = "id", estimate: Column | None = None,
                 scan: int = HISTORY_SCAN) -> DataFrame:
    """Important rows first, then newest; at most ``scan`` rows, cut where the running total overflows.

    Token counts are not negative, so "stop at the first overflow" is a filter on the running sum.
    ``estimate`` replaces counts that are missing or zero.
    """
    counted = F.coalesce(F.nullif(F.col("token_count"), F.lit(0)), estimate if estimate is not None else F.lit(None).cast("bigint"), F.lit(0).cast("bigint"))
    sort = [F.coalesce("important_flag", F.lit(False)).desc(), F.col("ts").desc(), F.col(order).desc()]
    kept = top_n(activity.withColumn("used_tokens", counted), ["user_id"], sort, scan)
    w = Window.partitionBy("user_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("running_tokens", F.sum("used_tokens").over(w)).where(F.col("running_tokens") <= max_tokens)


def keep_recent(messages: DataFrame, keep: int) -> DataFrame:
    """The last 2 * keep dialogue rows are recent, the rest older; short dialogues stay whole."""
    rows = numbered(dialogue(messages), ["conv_id"], turn_segment(), [F.col("turn")], "rn", total="dialogue_rows")
    long = F.col("dialogue_rows") > 2 * keep
    part = F.when(~long, "whole").when(F.col("rn") > F.col("dialogue_rows") - 2 * keep, "recent").otherwise("older")
    return rows.withColumn("part", part)


def restore(history: DataFrame, pairs: int = RESTORE_EXCHANGES) -> DataFrame:
    """The last exchanges as alternating messages; empty sides are left out, ``source_turn`` is the used id."""
    kept = top_n(history, ["conv_id"], [F.col("turn").desc()], pairs)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("user_message").alias("text")),
        F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("bot_response").alias("text")),
    )
    filled = F.filter(sides, lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return kept.select("conv_id", F.col("turn").alias("source_turn"), F.inline(filled))


def unused_history(history: DataFrame, used: DataFrame, skip: int = 5) -> DataFrame:
    """Exchanges not restored; conversations that restored nothing leave out their first ``skip``."""
    ids = used.select("conv_id", F.col("source_turn").alias("turn")).distinct()
    some = ids.select("conv_id").distinct()
    rest = history.join(some, "conv_id", "left_semi").join(ids, ["conv_id", "turn"], "left_anti")
    none = numbered(history.join(some, "conv_id", "left_anti"), ["conv_id"], turn_segment(), [F.col("turn")], "rn")
    return rest.unionByName(none.where(F.col("rn") > skip).drop("rn"))


def history_chunks(history: DataFrame, size: int = 10, longer_than: int = 20) -> DataFrame:
    """Histories above the limit in slices of ``size`` exchanges, the others as one slice."""
    rows = numbered(history, ["conv_id"], turn_segment(), [F.col("turn")], "rn", total="n")
    chunk = F.when(F.col("n") > longer_than, F.floor((F.col("rn") - 1) / size)).otherwise(F.lit(0)).cast("int")
    pair = F.struct("turn", "user_message", "bot_response")
    return (
        rows.groupBy("conv_id", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(pair)).alias("pairs")).withColumn("n_pairs", F.size("pairs"))
    )


def recent_text(messages: DataFrame, size: int = 4) -> DataFrame:
    """Last messages up to and including each one, squeezed, lower-cased and joined: context of R8c."""
    rows = numbered(messages, ["conv_id"], turn_segment(), [F.col("turn")], "__i")
    rows = rows.withColumn("__t", squeeze(F.lower(F.coalesce("text", F.lit("")))))
    out = trailing(rows, ["conv_id"], "__i", "__t", size, "__recent")
    joined = F.array_join(F.filter("__recent", lambda t: t != ""), " ")
    return out.withColumn("recent", joined).drop("__i", "__t", "__recent")


def _situated(messages: DataFrame, max_tokens: int, keep: int, lexicon: Lexicon) -> DataFrame:
    """Every row with what C3 decides by, from one summary per slice: whether its conversation overflows (``__full``), its class, whether it
    is an older dialogue row (``__older``), and whether that row is half of a pair without importance (``plain``, with its reply)."""
    each = estimate_tokens(F.coalesce("text", F.lit(""))) + 4 + F.when(F.col("role") == "system", 2).otherwise(0)
    talk = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    rows = messages.select("conv_id", "turn", "role", "text", talk.alias("__talk"))
    # Dialogue rows and the others are numbered apart; token totals are those of the whole conversation.
    rows = surroundings(
        rows, ["conv_id", "__talk"], turn_segment(), ["turn"], number="__rn",
        before={"role": "__br", "text": "__bt"}, after={"role": "__ar", "text": "__at", "turn": "__an"}, wider={"__each": (each, ["conv_id"]), "__talks": (F.col("__talk").cast("bigint"), ["conv_id"])})
    size = ((F.col("__each") + 4) * F.lit(1.05)).cast("bigint")
    rows = rows.withColumn("__big", size >= max_tokens)
    last_older = F.col("__talks") - 2 * keep
    older = F.col("__talk") & (F.col("__rn") <= last_older)
    user = F.col("role") == "user"
    # An older row's next row may be a recent one, which it is not paired with.
    next_older = F.col("__rn") + 1 <= last_older
    paired = older & F.coalesce(F.when(user, next_older & (F.col("__ar") == "assistant")).otherwise(F.col("__br") == "user"), F.lit(False))
    rows = rows.withColumn("__older", older).withColumn("__pair", paired & F.col("__big"))
    rows = rows.withColumn("__u", F.when(F.col("__pair"), F.when(user, F.col("text")).otherwise(F.col("__bt"))))
    rows = rows.withColumn("reply", F.when(F.col("__pair"), F.when(user, F.col("__at")).otherwise(F.col("text"))))
    rows = score(rows, lexicon, "__u")
    important = R.is_important(F.col("__u"), F.col("reply"), F.col("risk_level"))
    return rows.withColumn("plain", F.col("__pair") & ~important).withColumn("__class", role_class(F.col("role"), F.col("text")))


def compact(messages: DataFrame, *, max_tokens: int, keep: int = 30, lexicon: Lexicon = DEFAULT,
            summaries: DataFrame | None = None) -> DataFrame:
    """Rows that stay in the context, with their part and order (part_rank, turn).

    Conversations below ``max_tokens`` or with at most 2 * keep dialogue rows come back whole. In the others
    plain older pairs leave (see `compaction_buckets`); ``summaries`` (conv_id, summary) replaces the older
    summaries of a conversation whose pairs were summarised.
    """
    rows = _overflowing(_situated(messages, max_tokens, keep, lexicon), keep)
    kind = F.col("__class")
    part = (
        F.when(~F.col("__full"), "whole").when(kind == "preserved", "preserved").when(kind == "summary", "summary")
        .when((kind == "dialogue") & F.col("__older") & ~F.col("plain"), "passthrough")
        .when((kind == "dialogue") & ~F.col("__older"), "recent")
    )
    rank = F.when(F.col("part") == "summary", 1).when(F.col("part") == "passthrough", 2).when(F.col("part") == "recent", 3).otherwise(0)
    text = F.when(F.col("part") == "summary", strip(F.col("text"))).otherwise(F.col("text"))
    placed = rows.withColumn("part", part)
    out = placed.where(F.col("part").isNotNull()).select("conv_id", "turn", "role", text.alias("text"), "part", rank.alias("part_rank"))
    if summaries is None:
        return out
    pairs = placed.where(F.col("__full") & F.col("plain")).select("conv_id").distinct()
    usable = summaries.where(F.coalesce("summary", F.lit("")) != "").join(pairs, "conv_id", "left_semi")
    new = usable.select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system_summary").alias("role"),
                        F.concat(F.lit("Summary of the conversation so far: "), F.col("summary")).alias("text"),
                        F.lit("summary").alias("part"), F.lit(1).alias("part_rank"))
    kept = out.join(usable.select("conv_id", F.lit("summary").alias("part")), ["conv_id", "part"], "left_anti").select(*out.columns)
    return kept.unionByName(new)


def _overflowing(rows: DataFrame, keep: int) -> DataFrame:
    """``__full``: the conversation is too large and has more than 2 * keep dialogue rows. ``__talks`` counts those for all its rows."""
    return rows.withColumn("__full", F.col("__big") & (F.col("__talks") > 2 * keep))


def compaction_buckets(messages: DataFrame, *, max_tokens: int, keep: int = 30, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The plain older pairs that `compact` drops, sliced for summarising."""
    rows = _overflowing(_situated(messages, max_tokens, keep, lexicon), keep)
    pairs = rows.where(F.col("__full") & F.col("plain") & (F.col("role") == "user"))
    return history_chunks(pairs.select("conv_id", "turn", F.col("text").alias("user_message"),
                                       F.col("reply").alias("bot_response")))


SUMMARY_HEADER = "Further information (for the assistant only):\n"


def merge_summaries(messages: DataFrame, header: str = SUMMARY_HEADER) -> DataFrame:
    """C4: a conversation's summaries move into its first system row, or into a new first row.

    The merged text is one cell of the output by definition; only summary rows are brought together.
    """
    is_summary = F.col("role") == "system_summary"
    entry = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort("__s"), lambda s: s["text"]), "\n\n")
    merged = (
        messages.where(is_summary).groupBy("conv_id").agg(F.collect_list(entry).alias("__s"))
        .select("conv_id", F.btrim(joined, F.lit(WS_CHARS)).alias("__summary")).where(F.col("__summary") != "")
    )
    rest = messages.where(~is_summary)
    heads = rest.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("__head"))
    plan = merged.join(heads, "conv_id", "left")
    updates = plan.where(F.col("__head").isNotNull())
    added = plan.where(F.col("__head").isNull()).select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit(header), "__summary").alias("text"))
    targets = updates.select("conv_id", F.col("__head").alias("turn"), "__summary")
    text = F.when(F.col("__summary").isNull(), F.col("text")).otherwise(
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n" + header), "__summary"))
    changed = rest.join(targets, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", text.alias("text"))
    return changed.unionByName(added)


def latest_user_message(messages: DataFrame) -> DataFrame:
    """C5."""
    return messages.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("user_message"), F.max("turn").alias("turn"))


def system_context(messages: DataFrame) -> DataFrame:
    """A conversation's system texts, joined in order (one output cell by definition)."""
    entry = F.struct("turn", "text")
    return messages.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["text"]), "\n").alias("context"))


CONTEXT_MARK = "User context from the intake form:"


def inject_context(messages: DataFrame, contexts: DataFrame, mark: str = CONTEXT_MARK) -> DataFrame:
    """One system row with the user's context, after a leading system row or first; positions are renumbered."""
    ends = messages.groupBy("conv_id").agg(
        F.min("turn").alias("__first"), F.min_by("role", "turn").alias("__role"),
        F.max(F.coalesce(F.startswith("text", F.lit(mark)), F.lit(False))).alias("__marked"))
    at = F.col("__first") + F.when(F.col("__role") == "system", F.lit(0.5)).otherwise(F.lit(-0.5))
    new = contexts.join(ends.where(~F.col("__marked")), "conv_id").select(
        "conv_id", at.alias("position"), F.lit("system").alias("role"),
        F.concat(F.lit(mark + "\n"), F.col("context")).alias("text"))
    rows = messages.select("conv_id", F.col("turn").cast("double").alias("position"), "role", "text").unionByName(new)
    placed = numbered(rows, ["conv_id"], turn_segment("position"), [F.col("position")], "rn")
    return placed.select("conv_id", (F.col("rn") - 1).alias("turn"), "role", "text")
