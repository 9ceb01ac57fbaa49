"""The given tables seen as domain tables, for Spark and for the checking SQL.

`Domain` builds DataFrames; `CTE` holds the same definitions as SQL, with their dependencies.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import even_tasks, measured_broadcasts, write_and_read
from ..sources.readers import load_table

NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-30"
TRAINED_AT = "2024-01-20 00:00:00"
LI_TRAINED_AT = "1999-06-01 00:00:00"

WORDS = ("red", "blue", "hot", "cold", "small ring", "bolts", "gizmo", "large", "Old & new", "plate")
NAMES = ("Red", "bolts", "gizmo", "small ring", "hot", "small", "", "large")
GROUPS = ("fructans_gos", "lactose", "excess_fructose", "polyols", "gas_producing", "fatty_spicy_processed",
          "caffeine_alcohol_fizzy", "fiber_sensitive")
UNITS = ("g", "cups", "Pieces", "", "slice")
RULE = {"masks": ("small ring", "cold"), "aliases": {"hot": ("anvil", "red rod"), "large": ("widget",)},
        "masked_names": ("small", "hot")}
ALIASES = {
    "fructans_gos": ("red", "blue bolts", "widget"), "lactose": ("small gear", "plates"), "excess_fructose": ("hot",),
    "polyols": ("cold ring", "gizmos"), "gas_producing": ("economy", "old"), "fatty_spicy_processed": ("anvil", "new"),
    "caffeine_alcohol_fizzy": ("promo",), "fiber_sensitive": ("large", "rods"),
}
KEYWORDS = {"red": 0.6, "ring": 0.5, "gizmo": 0.4, "bolts": 0.35, "economy": 0.3}


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


class Domain:
    def __init__(self, spark: SparkSession, base: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        measured_broadcasts(spark)
        even_tasks(spark)
        self.spark, self.base, self._kept = spark, base, {}

    def kept(self, name: str) -> DataFrame:
        """A derived frame written once, for queries that use it in several branches."""
        if name not in self._kept:
            self._kept[name] = write_and_read(getattr(self, name), name)
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.base, name)

    @cached_property
    def recipes(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        word = F.get(F.split("p_name", " "), F.lit(1))
        nut = F.array(F.col("p_retailprice") - 900 + size * 10, size.cast("double"), (k % 60).cast("double"),
                      (k % 45).cast("double"), (k % 50).cast("double"), size / 2, (k % 90).cast("double"))
        return self.table("part").select(
            k.alias("recipe_id"), F.col("p_name").alias("name"),
            F.when(size % 25 == 0, F.array().cast("array<string>")).otherwise(
                F.array("p_name", F.lower("p_type"), F.concat(word, F.lit("s")))).alias("ingredients"),
            F.when(size != 13, size).cast("long").alias("minutes"), (size % 17).cast("long").alias("n_steps"),
            F.when(size % 10 != 4, 3).cast("long").alias("n_ingredients"),
            F.when(size % 20 == 7, F.slice(nut, 1, 3)).otherwise(nut).alias("nutrition"), F.col("p_brand").alias("description"),
            F.when(size % 3 == 1, True).when(size % 3 == 2, False).alias("is_ibs_friendly"))

    @cached_property
    def bought(self) -> DataFrame:
        li, o = self.table("lineitem"), self.table("orders")
        return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
            F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("recipe_id"), "l_quantity", "l_returnflag", "l_linenumber",
            F.col("l_shipdate").alias("created_at"), "l_orderkey")

    @cached_property
    def historical(self) -> DataFrame:
        return self.bought.select(F.col("cust").alias("user_id"), "recipe_id", (1 + F.col("l_quantity") % 5).cast("double").alias("rating"))

    @cached_property
    def ratings(self) -> DataFrame:
        return self.historical.withColumn("user_id", F.col("user_id").cast("string"))

    @cached_property
    def mean_ratings(self) -> DataFrame:
        return self.ratings.groupBy("user_id", "recipe_id").agg(F.avg("rating").alias("rating"))

    @cached_property
    def orders_log(self) -> DataFrame:
        kind = (F.when(F.col("l_returnflag") == "A", "liked").when(F.col("l_returnflag") == "R", "dismissed")
                .when(F.col("l_linenumber") == 1, "saved").when(F.col("l_linenumber") == 2, "save")
                .when(F.col("l_linenumber") == 3, "completed").otherwise("viewed"))
        return self.bought.select(F.col("cust").cast("string").alias("user_id"), "recipe_id", kind.alias("interaction_type"), "created_at")

    @cached_property
    def events(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type", "value",
                        F.get_json_object("props", "$.k").cast("long").alias("k"))

    @cached_property
    def app_log(self) -> DataFrame:
        t = F.col("event_type")
        kind = (F.when(t == "view", "viewed").when(t == "click", "liked").when(t == "purchase", "saved")
                .when(t == "signup", "started").otherwise("shared"))
        return self.events.select(F.col("event_id").alias("id"), "user_id", F.col("k").alias("recipe_id"), kind.alias("interaction_type"),
                                  F.col("ts").alias("created_at"))

    @cached_property
    def users(self) -> DataFrame:
        return self.events.select("user_id").distinct()

    @cached_property
    def meals(self) -> DataFrame:
        e, i = self.events.where("event_type = 'purchase'"), F.col("event_id")
        names = self.table("part").select(F.col("p_partkey").alias("k"), "p_name")
        return e.join(names, "k", "left").select(
            i.alias("meal_log_id"), i.alias("meal_id"), "user_id", F.when(i % 7 != 0, F.col("k")).alias("recipe_id"),
            F.col("p_name").alias("food_name"), F.col("ts").alias("logged_at"), ((i % 3) / 2.0).alias("portion_size"),
            pick(UNITS, i % 5).alias("portion_unit"), F.when(i % 4 == 0, F.col("value")).alias("calories"),
            F.when(i % 8 == 0, F.col("value") / 10).alias("protein_g"), F.when(i % 12 == 0, F.col("value") / 20).alias("fat_g"),
            F.when(i % 4 == 0, "manual").alias("nutrition_source"), F.when(i % 4 == 0, 0.5).alias("nutrition_confidence"),
            F.lit(None).cast("string").alias("notes"))

    @cached_property
    def reports(self) -> DataFrame:
        i, bad = F.col("event_id"), F.col("event_type") == "error"
        return self.events.where("event_type in ('error', 'signup')").select(
            i.alias("report_id"), "user_id", F.col("ts").alias("reported_at"),
            F.when(bad & (i % 10 != 0), "bloating").otherwise("none").alias("symptom_type"),
            F.when(bad, F.col("value") / 500).otherwise(0.0).alias("severity"), (~bad).alias("no_symptoms"),
            F.lit(None).cast("string").alias("notes"))

    @cached_property
    def exposures(self) -> DataFrame:
        from ..operators.exposure import meal_exposures

        empty = self.spark.createDataFrame([], "recipe_id long, ingredient_name string")
        return meal_exposures(self.meals, empty, self.recipes)

    @cached_property
    def raw_checkins(self) -> DataFrame:
        i = F.col("event_id")
        names = self.table("part").select(F.col("p_partkey").alias("k"), "p_name", F.lower("p_type").alias("p_type"))
        none = F.array().cast("array<string>")
        return self.events.where("event_type = 'click'").join(names, "k").select(
            i.alias("checkin_id"), "user_id", F.col("ts").alias("created_at"),
            F.when(i % 17 == 0, "unknown").otherwise((F.col("value") / 500).cast("string")).alias("severity"),
            F.array(F.lit("cramps"), F.lit("gas")).alias("symptoms"),
            F.when(i % 11 == 0, "  ").otherwise("felt it").alias("summary"), (i % 2 == 0).alias("complete"),
            F.create_map(F.lit("hours_0_8"), F.array("p_name", F.lit(" ")), F.lit("hours_9_16"),
                         F.when(i % 13 == 0, none).otherwise(F.array("p_name", "p_type")),
                         F.lit("hours_17_24"), F.array(F.concat("p_name", F.lit("s")))).alias("food_windows"))

    @cached_property
    def checkins(self) -> DataFrame:
        from ..operators.checkins import validate_checkins

        return validate_checkins(self.raw_checkins).where("valid")

    @cached_property
    def restrictions(self) -> DataFrame:
        c = F.col("c_custkey")
        kind = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "allergy").when(F.col("c_mktsegment") == "BUILDING", "Strict-Sensitivity")
                .otherwise("preference"))
        name = pick(NAMES, c % len(NAMES))
        return self.table("customer").where("c_mktsegment != 'HOUSEHOLD'").select(
            c.cast("string").alias("user_id"), name.alias("ingredient_name"), F.lower(name).alias("normalized_name"),
            kind.alias("restriction_type"), F.when(c % 3 == 1, False).when(c % 3 == 2, True).alias("is_strict"),
            F.lit("strict").alias("severity"), F.lit(None).cast("string").alias("notes"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((c % 20).cast("int"))).alias("created_at"))

    @cached_property
    def generic_risks(self) -> DataFrame:
        c = F.col("c_custkey")
        base = self.table("customer").select(c, F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        j = F.col("j")
        name = pick(WORDS, (c + 3 * j) % len(WORDS))
        at = F.lit("2023-12-01").cast("timestamp") + F.make_dt_interval((c % 60).cast("int"))
        return base.select(
            c.cast("string").alias("user_id"), name.alias("ingredient_name"), F.lower(name).alias("normalized_name"),
            (((c + 31 * j) % 97) / 97).alias("risk_score"), (((c + 7 * j) % 53) / 53).alias("confidence"),
            ((c + j) % 9).cast("long").alias("exposure_count"), ((c % 5) / 2).alias("positive_evidence"), ((c % 7) / 4).alias("negative_evidence"),
            F.lit("unknown").alias("status"), at.alias("last_evidence_at"), at.alias("updated_at"))

    @cached_property
    def profile_risks(self) -> DataFrame:
        c = F.col("c_custkey")
        at = F.lit("2023-12-10").cast("timestamp") + F.make_dt_interval((c % 45).cast("int"))
        return self.table("customer").where("c_acctbal > 0").select(
            c.cast("string").alias("user_id"), pick(WORDS, (c + 3) % len(WORDS)).alias("ingredient_name"),
            pick(GROUPS, c % 8).alias("trigger_group"), ((c % 89) / 89).alias("grade"), ((c % 41) / 41).alias("confidence"),
            (c % 6).cast("long").alias("evidence_count"), at.alias("last_evidence_at"), at.alias("updated_at"))

    @cached_property
    def ingredient_catalog(self) -> DataFrame:
        """One ingredient per distinct part word, with a group and a plural alias."""
        words = self.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
        return words.select(F.col("w").alias("ingredient_name"), F.array(F.concat(F.lit("big "), "w")).alias("aliases"),
                            pick(GROUPS, F.length("w") % 8).alias("trigger_group"))

    @cached_property
    def priors(self) -> DataFrame:
        t = self.table("part").select(F.lower("p_type").alias("t")).distinct()
        return t.select(F.col("t").alias("ingredient_name"), F.col("t").alias("normalized_name"),
                        (F.length("t") / 20).alias("population_risk_score"),
                        F.when(F.length("t") > 6, 0.5).otherwise(0.0).alias("confidence"))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.bought.select(F.col("cust").cast("string").alias("user_id"), "recipe_id").distinct()

    @cached_property
    def preference(self) -> DataFrame:
        """Candidates: mean rating as the score, as many per user as ranking takes.  Ratings are put to their users once, for the
        means as well as for the ranks."""
        from ..operators.ranking import topn

        means = self.ratings.repartition("user_id").groupBy("user_id", "recipe_id").agg(F.avg("rating").alias("preference_score"))
        return topn(means)

    @cached_property
    def item_factors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("recipe_id"), (F.col("label") / 10.0).alias("bias"), F.col("label").alias("cluster"),
                        F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    @cached_property
    def cooklists(self) -> DataFrame:
        """List rows from orders: a list per priority, every fifth recipe is personal."""
        b = self.bought
        rid = F.when(F.col("recipe_id") % 5 == 0, F.concat(F.lit("personal-"), F.col("recipe_id").cast("string"))).otherwise(
            F.col("recipe_id").cast("string"))
        rows = b.groupBy(F.col("cust").cast("string").alias("user_id"), rid.alias("recipe_id"),
                         (F.col("l_linenumber") % 4).cast("long").alias("cooklist_id")).agg(
            F.max("created_at").alias("created_at"), F.max(F.col("l_orderkey")).alias("id"))
        num = F.regexp_extract("recipe_id", r"(\d+)$", 1).cast("long")
        return rows.select(
            "id", "user_id", "recipe_id", "cooklist_id", F.when(num % 3 != 0, F.concat(F.lit("Dish "), num.cast("string"), F.lit(" v"), F.col("cooklist_id").cast("string"))).alias("recipe_title"),
            F.when(num % 5 == 0, "personal").when(num % 2 == 0, "catalog").alias("recipe_source"),
            F.when(num % 5 == 0, pick(("red, small ring", "bolts\nblue", "gizmo"), num % 3)).alias("ingredients"), "created_at")


# ---- the same in SQL --------------------------------------------------------------------------------

def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def num_word(x: str) -> str:
    """Normalized words without singular forms, & kept as `and`."""
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def n_ing(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({num_word(x)}, ' '), lambda t: CASE "
            "WHEN length(t) <= 3 OR regexp_matches(t, '(ss|us|is)$') OR t IN ('gas', 'molasses') THEN t "
            "WHEN t = 'leaves' THEN 'leaf' WHEN t = 'loaves' THEN 'loaf' WHEN t = 'potatoes' THEN 'potato' "
            "WHEN t = 'tomatoes' THEN 'tomato' WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' "
            "WHEN regexp_matches(t, '(ches|shes|xes|zes)$') THEN left(t, length(t) - 2) "
            "WHEN t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END), ' ')")


def n_text(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9-]+', ' ', 'g'))"


def n_plain(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def has(hay: str, needle: str) -> str:
    return f"contains(' ' || {hay} || ' ', ' ' || {needle} || ' ')"


def mask(x: str, phrases) -> str:
    out = f"' ' || {x} || ' '"
    for p in phrases:
        out = f"replace({out}, ' {p} ', ' ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def c01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR NOT isfinite(({x})::DOUBLE) THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, ({x})::DOUBLE)) END)"


def r6(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def md5_unit(seed: int, *columns: str) -> str:
    """The number in [0, 1) of `ratings.hash_unit`."""
    return f"(('0x' || left(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 8))::BIGINT / 4294967296.0::DOUBLE)"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def status(risk: str, conf: str) -> str:
    return (f"CASE WHEN {conf} >= 0.65 AND {risk} >= 0.75 THEN 'known_bad' WHEN {risk} >= 0.55 THEN 'suspected_bad' "
            f"WHEN {conf} >= 0.65 AND {risk} <= 0.20 THEN 'known_good' WHEN {conf} >= 0.35 AND {risk} <= 0.35 THEN 'suspected_good' "
            "ELSE 'unknown' END")


def case_map(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "recipes": ((), """SELECT p_partkey AS recipe_id, p_name AS name,
        CASE WHEN p_size % 25 = 0 THEN []::VARCHAR[] ELSE [p_name, lower(p_type), split_part(p_name, ' ', 2) || 's'] END AS ingredients,
        CASE WHEN p_size <> 13 THEN p_size END::BIGINT AS minutes, (p_size % 17)::BIGINT AS n_steps,
        CASE WHEN p_size % 10 <> 4 THEN 3 END::BIGINT AS n_ingredients,
        CASE WHEN p_size % 20 = 7 THEN [p_retailprice - 900 + p_size * 10, p_size::DOUBLE, (p_partkey % 60)::DOUBLE]
             ELSE [p_retailprice - 900 + p_size * 10, p_size::DOUBLE, (p_partkey % 60)::DOUBLE, (p_partkey % 45)::DOUBLE,
                   (p_partkey % 50)::DOUBLE, p_size / 2.0::DOUBLE, (p_partkey % 90)::DOUBLE] END AS nutrition,
        p_brand AS description, CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END AS is_ibs_friendly FROM part"""),
    "ri": (("recipes",), f"""SELECT recipe_id, pos, ingredient_name, {n_ing('ingredient_name')} AS nn FROM (
        SELECT recipe_id, unnest(ingredients) AS ingredient_name, generate_subscripts(ingredients, 1) - 1 AS pos FROM recipes)"""),
    "bought": ((), """SELECT o_custkey AS cust, l_partkey AS recipe_id, l_quantity, l_returnflag, l_linenumber,
        l_shipdate AS created_at, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "ratings": (("bought",), "SELECT cust::VARCHAR AS user_id, recipe_id, 1 + l_quantity % 5 AS rating FROM bought"),
    "mean_ratings": (("ratings",), "SELECT user_id, recipe_id, avg(rating) AS rating FROM ratings GROUP BY ALL"),
    "orders_log": (("bought",), """SELECT cust::VARCHAR AS user_id, recipe_id, CASE WHEN l_returnflag = 'A' THEN 'liked'
        WHEN l_returnflag = 'R' THEN 'dismissed' WHEN l_linenumber = 1 THEN 'saved' WHEN l_linenumber = 2 THEN 'save'
        WHEN l_linenumber = 3 THEN 'completed' ELSE 'viewed' END AS interaction_type, created_at FROM bought"""),
    "ev": ((), """SELECT event_id, ts, user_id::VARCHAR AS user_id, event_type, value,
        json_extract_string(props, '$.k')::BIGINT AS k FROM events"""),
    "app_log": (("ev",), """SELECT event_id AS id, user_id, k AS recipe_id, CASE event_type WHEN 'view' THEN 'viewed'
        WHEN 'click' THEN 'liked' WHEN 'purchase' THEN 'saved' WHEN 'signup' THEN 'started' ELSE 'shared' END AS interaction_type,
        ts AS created_at FROM ev"""),
    "users": (("ev",), "SELECT DISTINCT user_id FROM ev"),
    "meals": (("ev",), f"""SELECT event_id AS meal_log_id, user_id, CASE WHEN event_id % 7 <> 0 THEN k END AS recipe_id,
        p_name AS food_name, ts AS logged_at, (event_id % 3) / 2.0::DOUBLE AS portion_size,
        {lst(UNITS)}[event_id % 5 + 1] AS portion_unit, CASE WHEN event_id % 4 = 0 THEN value END AS calories,
        CASE WHEN event_id % 8 = 0 THEN value / 10 END AS protein_g, CASE WHEN event_id % 12 = 0 THEN value / 20 END AS fat_g,
        CASE WHEN event_id % 4 = 0 THEN 'manual' END AS nutrition_source, CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE END AS nutrition_confidence
        FROM ev LEFT JOIN part ON p_partkey = k WHERE event_type = 'purchase'"""),
    "reports": (("ev",), """SELECT event_id AS report_id, user_id, ts AS reported_at,
        CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'bloating' ELSE 'none' END AS symptom_type,
        CASE WHEN event_type = 'error' THEN value / 500 ELSE 0.0 END::DOUBLE AS severity, event_type <> 'error' AS no_symptoms
        FROM ev WHERE event_type IN ('error', 'signup')"""),
    "exposures": (("meals", "ri"), f"""SELECT user_id, meal_log_id, m.recipe_id, ingredient_name, nn AS normalized_name,
        logged_at AS exposed_at, CASE WHEN portion_size IS NULL OR portion_size = 0 THEN 1.0 ELSE portion_size END::DOUBLE AS w
        FROM meals m JOIN ri ON m.recipe_id = ri.recipe_id WHERE nn <> ''
        UNION ALL SELECT user_id, meal_log_id, NULL, food_name, {n_ing('food_name')}, logged_at,
        CASE WHEN portion_size IS NULL OR portion_size = 0 THEN 1.0 ELSE portion_size END FROM meals
        WHERE recipe_id IS NULL AND {n_ing('food_name')} <> ''"""),
    "raw_checkins": (("ev",), """SELECT event_id AS checkin_id, user_id, ts AS created_at,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 500 END AS sev, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'felt it' END AS summary,
        event_id % 2 = 0 AS complete, [p_name] AS w0, CASE WHEN event_id % 13 = 0 THEN []::VARCHAR[] ELSE [p_name, lower(p_type)] END AS w1,
        [p_name || 's'] AS w2 FROM ev JOIN part ON p_partkey = k WHERE event_type = 'click'"""),
    "checkins": (("raw_checkins",), """SELECT * REPLACE (greatest(0.0, least(1.0, sev)) AS sev) FROM raw_checkins WHERE sev IS NOT NULL
        AND (NOT complete OR (summary <> '' AND len(w0) > 0 AND len(w1) > 0 AND len(w2) > 0))"""),
    "restrictions": ((), f"""SELECT c_custkey::VARCHAR AS user_id, {lst(NAMES)}[c_custkey % {len(NAMES)} + 1] AS ingredient_name,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'allergy' WHEN 'BUILDING' THEN 'Strict-Sensitivity' ELSE 'preference' END AS restriction_type,
        CASE c_custkey % 3 WHEN 1 THEN false WHEN 2 THEN true END AS is_strict FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""),
    "strict": (("restrictions",), f"""SELECT DISTINCT user_id, {n_ing('ingredient_name')} AS name FROM restrictions
        WHERE restriction_type IN ('allergy', 'Strict-Sensitivity') OR coalesce(is_strict, false)"""),
    "generic_risks": ((), f"""SELECT c_custkey::VARCHAR AS user_id, {lst(WORDS)}[(c_custkey + 3 * j) % {len(WORDS)} + 1] AS ingredient_name,
        ((c_custkey + 31 * j) % 97) / 97.0::DOUBLE AS risk_score, ((c_custkey + 7 * j) % 53) / 53.0::DOUBLE AS confidence,
        (c_custkey + j) % 9 AS exposure_count, (c_custkey % 5) / 2.0::DOUBLE AS positive_evidence,
        (c_custkey % 7) / 4.0::DOUBLE AS negative_evidence, TIMESTAMP '2023-12-01' + to_days((c_custkey % 60)::INT) AS last_evidence_at
        FROM customer, (VALUES (0), (1)) t(j)"""),
    "profile_risks": ((), f"""SELECT c_custkey::VARCHAR AS user_id, {lst(WORDS)}[(c_custkey + 3) % {len(WORDS)} + 1] AS ingredient_name,
        {lst(GROUPS)}[c_custkey % 8 + 1] AS trigger_group, (c_custkey % 89) / 89.0::DOUBLE AS grade, (c_custkey % 41) / 41.0::DOUBLE AS confidence,
        c_custkey % 6 AS evidence_count, TIMESTAMP '2023-12-10' + to_days((c_custkey % 45)::INT) AS last_evidence_at
        FROM customer WHERE c_acctbal > 0"""),
    "ingredient_catalog": ((), f"""SELECT w AS ingredient_name, ['big ' || w] AS aliases, {lst(GROUPS)}[length(w) % 8 + 1] AS trigger_group
        FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"""),
    "priors": ((), """SELECT t AS ingredient_name, length(t) / 20.0::DOUBLE AS population_risk_score,
        CASE WHEN length(t) > 6 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT DISTINCT lower(p_type) AS t FROM part)"""),
    "pairs": (("bought",), "SELECT DISTINCT cust::VARCHAR AS user_id, recipe_id FROM bought"),
    "preference": (("mean_ratings",), """SELECT * FROM (SELECT user_id, recipe_id, rating AS preference_score,
        row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, recipe_id) AS rn FROM mean_ratings) WHERE rn <= 500"""),
    "item_factors": ((), """SELECT vec_id AS recipe_id, label / 10.0::DOUBLE AS bias, label AS cluster,
        list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings"""),
    "cooklists": (("bought",), f"""SELECT id, user_id, rid AS recipe_id, cooklist_id, created_at,
        CASE WHEN n % 3 <> 0 THEN 'Dish ' || n || ' v' || cooklist_id END AS recipe_title,
        CASE WHEN n % 5 = 0 THEN 'personal' WHEN n % 2 = 0 THEN 'catalog' END AS recipe_source,
        CASE WHEN n % 5 = 0 THEN ['red, small ring', 'bolts' || chr(10) || 'blue', 'gizmo'][n % 3 + 1] END AS ingredients
        FROM (SELECT cust::VARCHAR AS user_id, CASE WHEN recipe_id % 5 = 0 THEN 'personal-' || recipe_id ELSE recipe_id::VARCHAR END AS rid,
        recipe_id AS n, (l_linenumber % 4)::BIGINT AS cooklist_id, max(created_at) AS created_at, max(l_orderkey) AS id
        FROM bought GROUP BY ALL)"""),
}


def sql(body: str, *ctes: str, **extra: str) -> str:
    """`body` behind the named definitions and all they need; `extra` are definitions of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in CTE[name][0]:
            add(dep)
        order.append(name)

    for name in ctes:
        add(name)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def show(df: DataFrame) -> DataFrame:
    """Types that compare exactly: long, double to six places, string, boolean."""
    cols = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(t, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.ArrayType):
            e = t.elementType
            if isinstance(e, (T.FloatType, T.DoubleType)):
                raise TypeError(f"{f.name}: explode arrays of doubles before showing them")
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)
