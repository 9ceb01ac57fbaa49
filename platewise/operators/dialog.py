"""Conversation logs: food entries, allergy statements, labeled recipes, history, context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import vocab
from ..functions import numbers as num, text as tx
from ..session import write_and_read
from .matching import phrase_hits
from .ranking import latest_n


def food_terms(spark, terms=vocab.FOOD_TERMS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def classify_food(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """food, cancel or not_food by ordered rules; one-word terms also match with s or es."""
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    # Normalizing is the dear part, and both branches below and the filter use it: done once.
    told = write_and_read(messages.select("id", trimmed.alias("_b")).select("id", "_b", tx.normalize_text(F.col("_b")).alias("_n")), "messages")
    body, norm = F.col("_b"), F.col("_n")
    cancel = body.rlike(vocab.CANCEL_PATTERN)
    no = ((body == "") | (F.length(body) > 240) | body.rlike(vocab.STOCK_REPLY_PATTERN) | body.contains("?")
          | body.rlike(vocab.QUESTION_PATTERN) | (norm == "") | (F.size(F.split(norm, " ")) > 32))
    base = told.select("id", F.when(cancel, "cancel").when(no, "not_food").alias("kind"), "_n")
    term = tx.normalize_text(F.col("term"))
    forms = F.when(term.contains(" "), F.array(term)).otherwise(F.array(term, F.concat(term, F.lit("s")), F.concat(term, F.lit("es"))))
    phrases = vocabulary.select(F.explode(forms).alias("phrase")).where("phrase != ''").distinct()
    hits = phrase_hits(base.where("kind is null").select("id", "_n"), phrases, "_n").select("id").distinct().withColumn("_f", F.lit(True))
    return base.join(hits, "id", "left").select(
        "id", F.coalesce("kind", F.when(F.col("_f").isNotNull(), "food").otherwise("not_food")).alias("kind"))


def extract_allergies(messages: DataFrame) -> DataFrame:
    """Allergies stated in the first person: id, allergy.  A hedge within 45 characters before the
    statement voids it."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = messages.select("id", body.alias("t"))
    which = F.when(F.col("t").rlike(vocab.ALLERGY_PATTERNS[0] + "."), 0).when(F.col("t").rlike(vocab.ALLERGY_PATTERNS[1] + "."), 1)
    rows = rows.withColumn("_p", which).where("_p is not null")
    pos = F.when(F.col("_p") == 0, F.regexp_instr("t", F.lit(vocab.ALLERGY_PATTERNS[0] + "."))).otherwise(
        F.regexp_instr("t", F.lit(vocab.ALLERGY_PATTERNS[1] + ".")))
    rest = F.when(F.col("_p") == 0, F.regexp_extract("t", vocab.ALLERGY_PATTERNS[0] + "(.+)", 1)).otherwise(
        F.regexp_extract("t", vocab.ALLERGY_PATTERNS[1] + "(.+)", 1))
    start = F.greatest(F.lit(1), pos - 45)
    rows = rows.withColumn("_before", F.substring("t", start, pos - start)).withColumn("_rest", rest)
    rows = rows.where(~F.col("_before").rlike(vocab.HEDGE_PATTERN))
    first = lambda c, sep: F.get(F.split(c, sep), F.lit(0))
    tail = first(F.col("_rest"), r"[.!?](?:\s|$)")
    tail = first(tail, r"(?i)\s+(?:but|because|so|although|though|however)\b")
    tail = F.trim(first(tail, r"(?i)\s+(?:and\s+)?(?:i|can\s+you|could\s+you|would\s+you|please)\b"))
    parts = F.split(tail, r"(?i)\s*(?:,|;|/|&|\band\b|\bor\b)\s*")

    def clean(x: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^(?:and|or|both|all|any|the)\s+", ""),
                                       r"(?i)\s+(?:products?|foods?|ingredients?)$", ""))
        words = F.size(F.regexp_extract_all(bare, F.lit("(?i)[a-z0-9]+"), F.lit(0)))
        ok = (bare != "") & ~bare.rlike(vocab.NON_INGREDIENT_PATTERN) & (words > 0) & (words <= 5)
        return F.when(ok, tx.normalize_ingredient(bare)).otherwise("")

    names = F.array_distinct(F.filter(F.transform(parts, clean), lambda x: x != ""))
    return rows.select("id", F.explode(names).alias("allergy"))


def allergy_to_restrictions(allergies: DataFrame, notes: str | None = None) -> DataFrame:
    """Strict restriction rows, one per (user, name, type)."""
    name = tx.normalize_ingredient(F.col("allergy"))
    return (allergies.select("user_id", name.alias("normalized_name")).where("normalized_name != ''").distinct()
            .select("user_id", F.col("normalized_name").alias("ingredient_name"), "normalized_name",
                    F.lit("allergy").alias("restriction_type"), F.lit("strict").alias("severity"),
                    F.lit(True).alias("is_strict"), F.lit(notes).cast("string").alias("notes")))


def labeled(c: Column, *labels: str) -> Column:
    """The first label with a value, else the empty string."""
    out = F.lit("")
    for name in reversed(labels):
        got = F.regexp_replace(F.regexp_extract(c, rf"(?i)(?:^|\n)\s*{name}\s*:\s*([^\n]+)", 1), r"^\s+|\s+$", "")
        out = F.when(got != "", got).otherwise(out)
    return out


def parse_labeled_message(messages: DataFrame) -> DataFrame:
    """`label: value` lines as fields; the title falls back to the first free line, then to the text."""
    text = F.coalesce("text", F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    free = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(vocab.LABELED_LINE_PATTERN))
    line = strip(F.get(F.split(strip(F.array_join(free, "\n")), r"\r?\n"), F.lit(0)))
    title = labeled(text, "title", "recipe")
    return messages.select(
        "id", F.when(title != "", title).when(line != "", line).otherwise(strip(text)).alias("title"),
        labeled(text, "cooklist", "list").alias("cooklist"), labeled(text, "image").alias("image"),
        labeled(text, "ingredients").alias("ingredients"), labeled(text, "steps", "instructions").alias("instructions"),
        labeled(text, "notes").alias("notes"))


def trim_history(messages: DataFrame, n: int = vocab.CHAT_VISIBLE, greeting: str = vocab.CHAT_GREETING) -> DataFrame:
    """Valid messages of every conversation behind the greeting; of longer ones the greeting and the
    last n - 1."""
    ok = messages.where(F.col("role").isin("ai", "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    spans = ok.groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("f"), F.count(F.lit(1)).alias("c"))
    has = (F.col("f.role") == "ai") & (F.col("f.text") == greeting)
    spans = spans.select("conv_id", has.alias("has"), (F.col("c") + F.when(has, 0).otherwise(1)).alias("total"))
    everyone = messages.select("conv_id").distinct().join(spans, "conv_id", "left")
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    tail = (ok.withColumn("r", last).where(F.col("r") <= n).join(spans, "conv_id"))
    short = F.col("total") <= n
    keep = tail.where(F.when(short, ~F.col("has") | (F.col("r") < F.col("total"))).otherwise(F.col("r") <= n - 1))
    size = F.least(F.col("total"), F.lit(n))
    body = keep.select("conv_id", (size - F.col("r") + 1).alias("pos"), "role", "text")
    head = everyone.select("conv_id", F.lit(1).cast("long").alias("pos"), F.lit("ai").alias("role"), F.lit(greeting).alias("text"))
    return head.unionByName(body)


def _clean(c: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")), 1, n)


def _join(*parts: Column) -> Column:
    kept = F.filter(F.array(*[_clean(p, 120) for p in parts]), lambda x: x != "")
    return F.array_join(kept, ", ")


def _day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("date unknown"))


def _pct(c: Column) -> Column:
    d = c.cast("double")
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)) * 100 + 0.5).cast("string")
    return F.when(num.is_finite(d), F.concat(v, F.lit("%")))


def _tag(prefix: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(prefix), c))


SECTIONS = ("Recent meals", "Recent symptom check-ins", "Strict restrictions and avoid-list items",
            "Foods being watched", "Current recommended recipes", "Recent recipe activity")
CONTEXT_HEADER = ("Private app context for the signed-in user. Treat this as recent pattern-tracking context, "
                  "not medical truth.")


def context_assembly(meals: DataFrame, reports: DataFrame, checkins: DataFrame, restrictions: DataFrame, risks: DataFrame,
                     profile: DataFrame, interactions: DataFrame, recommended: DataFrame,
                     max_chars: int = vocab.CONTEXT_CHARS) -> DataFrame:
    """Bounded context text per user from eight sources, each cut to its newest few rows first.

    `recommended`: user_id, rn, name, match, minutes, updated_at.
    """
    top = lambda df, col, n, *keys: latest_n(df, "user_id", [F.col(col).desc(), *keys], n)
    unk = lambda c: F.coalesce(_pct(c), F.lit("unknown"))
    sev = lambda c: F.concat(F.lit("severity "), unk(c))
    row = lambda df, sec, src, text: df.select("user_id", F.lit(sec).alias("sec"), F.lit(src).alias("src"), F.col("rn").alias("k"),
                                               _clean(text, 260).alias("line"))
    windows = F.array_join(F.filter(F.array(*[
        F.when(F.size(w) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(F.transform(w, lambda x: _clean(x, 50)), 1, 4), ", ")))
        for label, w in zip(("0-8h", "9-16h", "17-24h"), vocab.CHECKIN_WINDOWS)]), lambda x: x.isNotNull()), "; ")
    parts = [
        row(top(meals, "logged_at", 8, "meal_log_id"), 0, 0, _join(
            F.concat_ws(" ", _day(F.col("logged_at")), _clean(F.col("food_name"), 80)),
            _tag("portion ", F.concat_ws(" ", F.col("portion_size").cast("string"), "portion_unit")), _tag("notes: ", _clean(F.col("notes"), 120)))),
        row(top(reports, "reported_at", 8, "report_id"), 1, 0, _join(
            F.concat_ws(" ", _day(F.col("reported_at")), F.when(F.col("no_symptoms"), "no symptoms").otherwise(_clean(F.col("symptom_type"), 60))),
            sev(F.col("severity")), _tag("notes: ", _clean(F.col("notes"), 120)))),
        row(top(checkins, "created_at", 4, "checkin_id"), 1, 1, _join(
            F.concat_ws(" ", _day(F.col("created_at")), F.lit("IBS chat check-in")), sev(F.col("severity")),
            _tag("symptoms: ", F.array_join(F.transform("symptoms", lambda x: _clean(x, 40)), ", ")),
            _tag("summary: ", _clean(F.col("summary"), 140)), _tag("foods: ", windows))),
        row(top(restrictions, "created_at", 20, "ingredient_name"), 2, 0, _join(
            _clean(F.col("ingredient_name"), 80), _clean(F.col("restriction_type"), 50),
            F.when(F.col("is_strict"), "strict").otherwise(_clean(F.col("severity"), 30)), _tag("notes: ", _clean(F.col("notes"), 100)))),
        row(top(risks, "risk_score", 8, "ingredient_name"), 3, 0, _join(
            _clean(F.col("ingredient_name"), 80), F.concat(F.lit("pattern score "), unk(F.col("risk_score"))),
            F.concat(F.col("exposure_count").cast("string"), F.lit(" exposures")), _clean(F.col("status"), 40),
            F.when(F.col("last_evidence_at").isNotNull(), F.concat(F.lit("last seen "), _day(F.col("last_evidence_at")))))),
        row(top(profile, "grade", 8, "ingredient_name"), 3, 1, _join(
            _clean(F.col("ingredient_name"), 80), F.concat(F.lit("IBS grade "), unk(F.col("grade"))),
            F.concat(F.col("evidence_count").cast("string"), F.lit(" signals")), _clean(F.col("trigger_group"), 50))),
        row(recommended.where("rn <= 5"), 4, 0, _join(
            F.col("name"), F.concat(_pct(F.col("match")), F.lit(" match")), F.concat(F.col("minutes").cast("string"), F.lit(" min")),
            F.when(F.col("updated_at").isNotNull(), F.concat(F.lit("updated "), _day(F.col("updated_at")))))),
        row(top(interactions, "created_at", 8, "recipe_title", "interaction_type"), 5, 0, _join(
            F.concat_ws(" ", _day(F.col("created_at")), _clean(F.col("interaction_type"), 40)), _clean(F.col("recipe_title"), 100))),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    # At most 61 short rows per user from here on.
    lists = lines.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("sec", "src", "k", "line"))).alias("x"), F.count(F.lit(1)).alias("source_count"))
    limits = {1: 10, 3: 12}

    def section(i: int) -> Column:
        own = F.transform(F.filter("x", lambda e: e["sec"] == i), lambda e: e["line"])
        if i in limits:
            own = F.slice(own, 1, limits[i])
        own = F.filter(own, lambda t: t != "")
        return F.when(F.size(own) > 0, F.concat(F.lit(SECTIONS[i] + ":\n- "), F.array_join(own, "\n- ")))

    text = F.concat_ws("\n", F.lit(CONTEXT_HEADER), *[section(i) for i in range(len(SECTIONS))])
    return lists.select("user_id", F.substring(text, 1, max_chars).alias("context_text"), "source_count")
