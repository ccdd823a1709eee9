"""The exposure report: aggregates of findings and topics. No value and no title of an export is in any of them.

Input: detected user messages (schema.MESSAGE with findings and topics). Each part is a grouping with partial sums; only
tops and one-row summaries pass through few tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mask_value, rounded, url_component, weight_of
from ..schema import TOPIC_WEIGHT


#: Fixed value: so many months without hits are filled in.
MOST_MONTHS = 1200


def users(messages: DataFrame, provider: str | None = None) -> DataFrame:
    """User messages, of one provider if it is named."""
    rows = messages.where("role = 'user'")
    return rows if provider is None else rows.where(F.coalesce("provider", F.lit("chatgpt")) == provider)


def hits(detected: DataFrame) -> DataFrame:
    """A row for each finding and topic flag: ord orders them as they are met.

    Masks and weights are made behind the explode: compiled there, and left out where nobody reads them."""
    none = F.lit(None).cast("string")
    f = F.transform("findings", lambda f, i: F.struct(F.lit(0).alias("kind"), i.alias("i"), f["type"].alias("category"), f["key"].alias("key"), f["value"].alias("value"), f["severity"].alias("severity")))
    t = F.transform("topics", lambda t, i: F.struct(F.lit(1).alias("kind"), i.alias("i"), t["topic"].alias("category"), none.alias("key"), none.alias("value"), none.alias("severity")))
    rows = detected.select("seq", "conversation_id", "created_at", F.explode(F.concat(f, t)).alias("h")).select("seq", "conversation_id", "created_at", "h.*")
    masked = F.when(F.col("kind") == 0, mask_value(F.col("category"), F.col("value"))).otherwise("Sensitive topic")
    weight = F.when(F.col("kind") == 0, weight_of(F.col("severity"))).otherwise(TOPIC_WEIGHT)
    return rows.select("conversation_id", "created_at", F.struct("seq", "kind", "i").alias("ord"), "kind", "category", "key", masked.alias("masked"), weight.alias("weight"))


def counts_by_type(hit: DataFrame) -> DataFrame:
    """Conversations of each category."""
    return hit.groupBy("category").agg(F.count_distinct("conversation_id").alias("conversations"))


def category_chart(hit: DataFrame) -> DataFrame:
    return counts_by_type(hit).orderBy(F.desc("conversations"), "category")


def top_repeated(hit: DataFrame, n: int = 5) -> DataFrame:
    """The values in most conversations, masked as they were first met."""
    each = hit.where("kind = 0").groupBy("category", "key").agg(F.count_distinct("conversation_id").alias("conversations"), F.min(F.struct("ord", "masked")).alias("first"))
    return each.orderBy(F.desc("conversations"), "first.ord").limit(n).select(F.col("category").alias("type"), F.col("first.masked").alias("masked"), "conversations")


def ordinals(user_messages: DataFrame) -> DataFrame:
    """conversation_id, first, n (its place among all conversations by first message) and last_at.

    Places are counted inside ranges of equal size first, and the ranges' sizes then summed, so that no task gets all
    conversations."""
    each = user_messages.groupBy("conversation_id").agg(F.min("seq").alias("first"), F.max("created_at").alias("last_at"))
    ranged = each.repartitionByRange("first").withColumn("_p", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions("first").withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return ranged.join(base, "_p").select("conversation_id", "first", (F.col("_base") + F.col("_i") + 1).alias("n"), "last_at")


def places(each: DataFrame, some: DataFrame) -> DataFrame:
    """conversation_id and n, its place by first message, of some conversations of a top: for each of these few, the
    conversations that begin no later are counted, with partial sums. each: conversation_id and first of all of them."""
    mine = each.join(F.broadcast(some.select("conversation_id")), "conversation_id", "left_semi").select("conversation_id", F.col("first").alias("_own"))  # as few as the top has
    return each.select("first").join(F.broadcast(mine), F.col("first") <= F.col("_own")).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


def conversation_risk(hit: DataFrame) -> DataFrame:
    """risk, categories in the order met, and up to six different examples of each conversation with hits.

    Examples are distinct before they are gathered, so a conversation gathers no more than its different masks."""
    risk = hit.groupBy("conversation_id").agg(F.sum("weight").alias("risk"), F.min("ord").alias("first"))
    each = hit.groupBy("conversation_id", "category", "masked").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("conversation_id").orderBy("ord")
    examples = each.withColumn("i", F.row_number().over(w)).where("i <= 6").groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ord", "category", "masked"))).alias("xs"))
    types = hit.groupBy("conversation_id", "category").agg(F.min("ord").alias("ord")).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ord", "category"))).alias("ts"))
    both = risk.join(types, "conversation_id").join(examples, "conversation_id")
    return both.select("conversation_id", "risk", "first", F.transform("ts", lambda x: x["category"]).alias("types"), F.transform("xs", lambda x: F.struct(x["category"].alias("type"), x["masked"].alias("masked"))).alias("examples"))


def riskiest(hit: DataFrame, user_messages: DataFrame, n: int = 10) -> DataFrame:
    """The conversations of most risk: then the later one, then the one met first. Only these get texts and titles."""
    # a row for each conversation, made from the messages once and read for the top and for places
    each = user_messages.groupBy("conversation_id").agg(F.max("created_at").alias("last_at"), F.min_by("conversation_url", "seq").alias("url"), F.min("seq").alias("first")).persist()
    times = each.drop("first")
    risk = hit.groupBy("conversation_id").agg(F.sum("weight").alias("risk"), F.min("ord").alias("first"))
    top = risk.join(times, "conversation_id").orderBy(F.desc("risk"), F.desc_nulls_last("last_at"), "first").limit(n)
    about = conversation_risk(hit.join(F.broadcast(top.select("conversation_id")), "conversation_id", "left_semi")).select("conversation_id", "types", "examples")  # n rows
    place = places(each, top).select("conversation_id", F.concat(F.lit("Conversation "), F.col("n").cast("string")).alias("title"))
    rows = top.join(about, "conversation_id").join(place, "conversation_id")
    url = F.coalesce("url", F.concat(F.lit("https://chatgpt.com/c/"), url_component(F.col("conversation_id"))))
    return rows.orderBy(F.desc("risk"), F.desc_nulls_last("last_at"), "first").select("conversation_id", "title", url.alias("url"), F.col("risk").alias("risk_score"), "types", "last_at", "examples")


def timeline(messages: DataFrame, hit: DataFrame) -> DataFrame:
    """Conversations with hits in each month from the first to the last message of any role, months without any too (of the
    first MOST_MONTHS months; later ones only where they have hits)."""
    month = lambda c: F.date_trunc("month", c)
    ends = messages.agg(month(F.min("created_at")).alias("a"), month(F.max("created_at")).alias("b")).where("a is not null")
    last = F.least(F.col("b"), F.add_months("a", MOST_MONTHS - 1).cast("timestamp"))
    months = ends.select(F.explode(F.sequence("a", last, F.expr("interval 1 month"))).alias("m"))
    counts = hit.where("created_at is not null").groupBy(month(F.col("created_at")).alias("m")).agg(F.count_distinct("conversation_id").alias("n"))
    return months.join(counts, "m", "full_outer").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("conversations"))


def privacy_score(risk: Column, conversations: Column) -> Column:
    """100 less 12 for each doubling of the risk of a conversation, from 0 to 100."""
    lost = F.least(F.lit(100.0), 12 * F.log2(1 + F.coalesce(risk, F.lit(0)) / F.greatest(F.lit(1), conversations) * 10))
    return F.least(F.lit(100), F.greatest(F.lit(0), rounded(100 - lost)))


def summary(messages: DataFrame, hit: DataFrame, model_used: bool = False) -> DataFrame:
    """One row: what the report says of all messages together."""
    about = messages.agg(
        F.count_distinct("conversation_id").alias("conversations"), F.count_if(F.col("role") == "user").alias("messages"), F.min("created_at").alias("from"), F.max("created_at").alias("to"),
        F.coalesce(F.bool_or(F.col("provider") == "gemini"), F.lit(False)).alias("activity_based"),
    )
    first = messages.groupBy(F.coalesce("provider", F.lit("chatgpt")).alias("p")).agg(F.min("seq").alias("s"))
    providers = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "p"))), lambda x: x["p"]).alias("providers"))
    found = hit.agg(F.count_distinct("conversation_id").alias("conversations_with_findings"), F.count_if(F.col("kind") == 0).alias("findings"), F.coalesce(F.sum("weight"), F.lit(0)).alias("risk"))
    one = about.crossJoin(providers).crossJoin(found)  # one row each
    return one.withColumn("privacy_score", privacy_score(F.col("risk"), F.col("conversations"))).withColumn("ai_name_detection", F.lit(model_used))


def dashboard_totals(report: DataFrame, live: DataFrame) -> DataFrame:
    """The report and what was shared since, as one row. report: summary with categories (array); live: live_stats."""
    both = report.crossJoin(live.select(*[F.col(c).alias(f"live_{c}") for c in live.columns]))  # one row each
    return both.select(
        (F.col("messages") + F.col("live_prompts")).alias("messages"), (F.col("findings") + F.col("live_shared")).alias("findings"),
        F.size(F.array_union("categories", "live_categories")).alias("categories"), F.greatest(F.lit(0), F.col("privacy_score") - F.col("live_cost")).alias("score"),
    )


def import_summaries(imports: DataFrame) -> DataFrame:
    """The latest import of each set of providers."""
    keyed = imports.withColumn("id", F.array_join(F.array_sort(F.array_distinct("providers")), "+"))
    rest = [c for c in keyed.columns if c != "id"]
    return keyed.groupBy("id").agg(F.max_by(F.struct(*rest), "imported_at").alias("v")).select("id", "v.*")


def cleanup_progress(risky: DataFrame, cleaned: DataFrame) -> DataFrame:
    """How many of the listed conversations are marked as cleaned."""
    marks = cleaned.select("conversation_id", F.lit(1).alias("done")).distinct()
    return risky.select("conversation_id").join(marks, "conversation_id", "left").agg(F.count(F.lit(1)).alias("listed"), F.count("done").alias("cleaned"))
