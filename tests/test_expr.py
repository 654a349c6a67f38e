import hashlib
import time

from pyspark.sql import functions as F

from factloom.functions import expr


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_stable_id_folds_and_hashes(spark):
    want = "p:" + hashlib.sha256("a\x1fb".encode()).hexdigest()[:20]
    assert one(spark, expr.stable_id("p", F.lit(" A "), F.lit("b"))) == want
    assert one(spark, expr.stable_id("p", F.lit("Ａ"), F.lit("B"), unicode=True)) == want
    assert one(spark, expr.stable_id("p", F.lit(None).cast("string"))) == "p:" + hashlib.sha256(b"").hexdigest()[:20]


def test_family_and_aliases(spark):
    assert one(spark, expr.family_name(F.lit("  Fire  Slash (SA)＋"))) == "fire slash"
    assert one(spark, expr.aliases(F.lit("Mia (Alt), Blade"))) == ["Mia (Alt), Blade", "Mia (Alt)", "Blade", "Mia Alt"]
    assert one(spark, expr.aliases(F.lit("Mia"))) == ["Mia"]


def test_slot_eligibility_takes_the_first_rule(spark):
    get = lambda *a: one(spark, expr.slot_eligibility(*(F.lit(x).cast("string") for x in a)))
    assert get("x", "Passive", None, None) == "not_equipable"
    assert get("Another Zone", None, None, "") == "not_equipable"
    assert get("x", None, None, "It replaces basic attack") == "basic_attack_replacement"
    assert get("x", None, None, " Basic attack: hit") == "ordinary_basic_attack"
    assert get("x", None, None, None) == "active_equipable"


def test_numbers(spark):
    rows = spark.createDataFrame([("1,234 dmg",), ("-5",), ("12.5%",), ("junk",), (None,)], "t string").select(expr.to_int("t").alias("i"), expr.abs_int("t").alias("a"), expr.to_float("t").alias("f")).collect()
    assert [r["i"] for r in rows] == [1234, -5, 12, None, None]
    assert [r["a"] for r in rows] == [1234, 5, 12, None, None]
    assert [r["f"] for r in rows] == [None, -5.0, 12.5, None, None]


def test_tags_keep_the_order_of_their_table(spark):
    assert one(spark, expr.effect_tags(F.lit("Magic FIRE damage"))) == ["element:fire", "attack:magic", "combat:damage"]
    assert one(spark, expr.needle_tags(F.lit("Poison and barrier"))) == ["barrier", "status ailment"]
    assert one(spark, expr.effect_tags(F.lit(None).cast("string"))) == []


def test_acquisition(spark):
    get = lambda t, tier: tuple(one(spark, expr.acquisition(F.lit(t), F.lit(tier))))
    assert get("∞ drops", 1) == ("repeatable", None)
    assert get("1x chest", 1) == ("unique", 1)
    assert get("3: shop", 1) == ("finite", 3)
    assert get("?", 3) == ("unique", 1)
    assert get("?", 2) == ("unknown", None)


def test_value_state_keeps_unknown_from_empty(spark):
    rows = spark.createDataFrame([(["a"],), ([],), (["Unknown"],), (None,)], "v array<string>").select(expr.value_state("v").alias("s")).collect()
    assert [r["s"] for r in rows] == ["confirmed_values", "confirmed_empty", "unknown", "unknown"]


def test_urls_and_slugs(spark):
    assert tuple(one(spark, expr.canonical_url(F.lit("/w/A%20B/?x=1#c"), "http://h/"))) == ("http://h/w/A_B", "c")
    assert one(spark, expr.slug(F.lit("  A b-C! "))) == "a_b_c"
    assert one(spark, expr.slug(F.lit("!!"))) == "unknown"


def test_normalize_and_tokens(spark):
    n = lambda f, v: one(spark, expr.normalize_field(F.lit(f), F.lit(v)))
    assert [n("x", "1.50"), n("x", "+3.0"), n("x", "All Enemies"), n("trigger", "always")] == ["1.5", "3", "all_enemies", "none"]
    assert one(spark, expr.dependency_token(F.lit("My Sword"))) == "requires_my_sword"


def test_corpus_fingerprint_is_independent_of_partitions(spark):
    df = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert expr.corpus_fingerprint(df, "h").collect() == expr.corpus_fingerprint(df.repartition(7), "h").collect()


def test_qualifiers_read_a_long_run_once(spark):
    """From each word of a run without a sign the rest of the run was read again: 200,000 characters took minutes."""
    rows = [("a b " * 50_000 + "personalitys",), ("a b " * 50_000 + "Quick Personality",), ("9. personality",), ("é- personality",), ("x - personality",)]
    began = time.time()
    df = spark.createDataFrame(rows, "text string").select(expr.qualifiers("text")["eligibility"].alias("e"), F.length("text").alias("n"))
    assert [r["e"] for r in df.collect()] == [[], ["personality"], [], ["personality"] if one(spark, F.lit("é-").rlike(r"\b-")) else [], ["personality"]]
    assert time.time() - began < 30


def test_the_text_of_qualifier_fields_is_made_once(spark):
    from factloom.plans import evidence

    plan = evidence.R.queries["qualifier_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".5 % Fire damage") == 1
