"""Scalar functions (F1-F24) and name and hash distances (D5, D9-D11) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import entities as en
from granary.functions import scalars as fn
from granary.plans.base import Plans
from granary.plans.fact_sql import ENTITIES
from granary.sources.tables import table

plans = Plans()


@plans.query(r"select p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) as plain, trim(regexp_replace(lower('É. ' || p_name), '[^\p{L}\p{N}]+', ' ', 'g')) as any_script from part")
def f1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names, of ASCII and of any script."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.plain_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("plain"), fn.unicode_name(F.concat(F.lit("É. "), "p_name")).alias("any_script"))


@plans.query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def f2_clinical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three forms, read back."""
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fn.clinical_day(form), "yyyy-MM-dd").alias("day"))


@plans.query("select o_orderkey, case when o_orderkey % 4 = 3 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def f3_strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years, month first where only that fits, and days that don't exist."""
    us = F.when(F.dayofmonth("o_orderdate") > 12, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    form = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd-MM-yy")).when(F.col("o_orderkey") % 4 == 1, us).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "d MMM yyyy")).otherwise("31/02/2020")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fn.strict_day(form), "yyyy-MM-dd").alias("day"))


@plans.query("select o_orderkey, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 2) end as amount from orders")
def f4_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with signs, commas and endings, read back; residue makes them null."""
    written = F.format_number(F.round("o_totalprice", 2), 2)
    form = F.when(F.col("o_orderkey") % 5 == 0, F.concat(written, F.lit(" approx"))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("Rs. "), written, F.lit("/-"))).when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("₹"), written)).otherwise(F.concat(F.lit("INR "), written))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.amount(form).alias("amount"))


@plans.query("select l_orderkey, l_linenumber, round(case when l_returnflag = 'A' then l_extendedprice * (1 - l_discount) when l_returnflag = 'N' then l_extendedprice else l_quantity * l_tax end, 4) as amount from lineitem")
def f5_line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first amount of a line that is there."""
    flag = F.col("l_returnflag")
    net, gross = F.when(flag == "A", F.col("l_extendedprice") * (1 - F.col("l_discount"))), F.when(flag == "N", F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.line_amount(net, gross, F.col("l_quantity"), F.col("l_tax")), 4).alias("amount"))


@plans.query(ENTITIES)
def f6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile numbers and dates as plain patterns have them in whole texts, then registrations, identities, mobile numbers, dates and amounts, each kind sorted."""
    text = F.coalesce("text", F.lit(""))
    plain = [F.size(F.regexp_extract_all(text, F.lit("[6-9][0-9]{9}"), 0)).cast("long").alias("n_mobile"), F.size(F.regexp_extract_all(text, F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0)).cast("long").alias("n_dates"), F.regexp_extract(text, "[6-9][0-9]{9}", 0).alias("first_mobile")]
    kinds = [F.array_join(F.array_sort(F.array_distinct(found)), ",").alias(name) for name, found in en.facts(text).items()]
    amounts = F.array_join(F.transform(F.array_sort(en.amounts(text)), lambda a: F.format_string("%.2f", a)), ",").alias("amounts")
    return table(spark, sf_dir, "documents").select("doc_id", *plain, *kinds, amounts)


CHECKED = "select o_orderkey, digits, regexp_matches(digits, '^[2-9][0-9]{11}$') and c12 = 0 as valid from ({steps})"


def check_digit_sql(around: str = "{checked}") -> str:
    """The check digit step by step, from the last digit on."""
    steps = "".join(f", substr([{', '.join(map(repr, fn.VERHOEFF_D))}][c{i} + 1], substr('{fn.VERHOEFF_P[i % 8]}', substr(digits, {12 - i}, 1)::int + 1, 1)::int + 1, 1)::int as c{i + 1}" for i in range(12))
    inner = f"select o_orderkey, lpad((o_orderkey * 7919 + 200000000000)::varchar, 12, '0') as digits, 0 as c0{steps} from orders"
    return around.replace("{checked}", CHECKED.replace("{steps}", inner))


@plans.query(check_digit_sql())
def f7_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-digit numbers with a right check digit."""
    digits = F.lpad((F.col("o_orderkey") * 7919 + 200_000_000_000).cast("string"), 12, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits"), fn.verhoeff_valid(digits).alias("valid"))


@plans.query("select event_id, case when value between 36 and 42 then value when value * 10 between 36 and 42 then value * 10 when value * 100 between 36 and 42 then value * 100 when value * 0.1 between 36 and 42 then value * 0.1 when value * 0.01 between 36 and 42 then value * 0.01 end as fixed from events")
def f8_bounds_with_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values brought within bounds by moving the decimal point."""
    return table(spark, sf_dir, "events").select("event_id", fn.bounded_value(F.col("value"), 36.0, 42.0).alias("fixed"))


@plans.query("select l_orderkey, l_linenumber, case when d < 0 or d > 365 then 'abstain' when d > 120 then 'warn' else 'ok' end as verdict from (select *, l_shipdate::date - o_orderdate::date as d from lineitem join orders on o_orderkey = l_orderkey)")
def f9_stay_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of stay that can't be or are unusual."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", fn.stay_check(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).alias("verdict"))


@plans.query(r"select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '([0-9]+)', 1) as number from pages")
def f10_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and first numbers of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@plans.query("select event_id, len(json_keys(props))::bigint as n_keys, json_type(props) = 'OBJECT' as is_object, array_to_string(json_keys(props), ',') as keys from events")
def f11_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and names of keys, and whether it is an object."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).cast("long").alias("n_keys"), keys.isNotNull().alias("is_object"), F.array_join(keys, ",").alias("keys"))


@plans.query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' as merged from events""")
def f12_json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair added to a JSON object."""
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(merged["k"].cast("long").alias("k"), merged["kind"].alias("kind"))).alias("merged"))


@plans.query("select user_id, coalesce(string_agg(event_type, ',' order by event_type) filter (where event_type <> 'error'), '') as kinds from (select distinct user_id, event_type from events) group by user_id")
def f13_array_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry taken out of a list."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return kinds.select("user_id", F.array_join(F.filter("l", lambda x: x != "error"), ",").alias("kinds"))


@plans.query("select p_partkey, 'Item ' || p_name || ' of ' || p_brand || ' costs ' || printf('%.2f', p_retailprice) as text from part")
def f14_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled from columns."""
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("Item %s of %s costs %.2f", "p_name", "p_brand", "p_retailprice").alias("text"))


@plans.query("""select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as key from nation""")
def f16_stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rows as JSON with sorted keys."""
    return table(spark, sf_dir, "nation").select("n_nationkey", fn.stable_key("n_regionkey", "n_name", "n_nationkey").alias("key"))


@plans.query("select user_id, round(least(0.99, greatest(0.5, 1 - exp(-count(*) / 8.0))), 6) as confidence from events group by user_id")
def f17_saturating_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence that grows with evidence."""
    from granary.operators.mining import saturating_confidence

    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(saturating_confidence(F.count("*")), 6).alias("confidence"))


@plans.query("select o_orderkey, (ceil((pages * 2.0 + case when calls > 0 then 30.0 + (calls - 1) * 10.0 else 0.0 end) * 1.2 / 10) * 10)::bigint as cost from (select o_orderkey, o_orderkey % 40 as pages, o_orderkey % 7 as calls from orders)")
def f20_run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated cost of a run from its pages and calls."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.run_cost(F.col("o_orderkey") % 40, F.col("o_orderkey") % 7).cast("long").alias("cost"))


MESSAGES = " ".join(f"when regexp_matches(lower(text), '{pattern}') then '{name}'" for name, pattern in fn.MESSAGE_RULES)


@plans.query(f"select conv_id, turn, role, case {MESSAGES} else 'other' end as class from conversations")
def f22_message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the first keyword rule that matches."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", fn.message_class(F.col("text")).alias("class"))


@plans.query("select l_orderkey, l_linenumber, round(least(1, greatest(0, case when l_returnflag = 'R' and l_linestatus = 'F' then least(l_quantity / 50, 0.4) else l_quantity / 50 end - case when l_tax > 0.06 then 0.1 else 0 end)), 6) as confidence from lineitem")
def f23_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence capped by what is missing or contradictory."""
    gate = fn.completeness_gate(F.col("l_quantity") / 50, F.col("l_returnflag") == "R", F.col("l_linestatus") != "F", F.col("l_tax") > 0.06)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(gate, 6).alias("confidence"))


@plans.query("with h as (select doc_id, md5(coalesce(text, '')) as a, md5(coalesce(lang, '') || doc_id) as b from documents) select doc_id, (" + " + ".join(f"bit_count(xor(('0x' || a[{i}:{i + 7}])::bigint, ('0x' || b[{i}:{i + 7}])::bigint))::bigint" for i in range(1, 33, 8)) + ")::bigint as distance from h")
def d5_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits between two hex digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("a"), F.md5(F.concat(F.coalesce("lang", F.lit("")), "doc_id")).alias("b"))
    return docs.select("doc_id", fn.hamming_hex(F.col("a"), F.col("b"), 32).alias("distance"))


NAMES = "pairs as (select p_partkey, p_name as a, lag(p_name) over (partition by p_brand order by p_partkey) as b from part)"


@plans.query(f"""with {NAMES}, d as (select *, list_distinct(string_split(trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')), ' ')) as x, list_distinct(string_split(trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')), ' ')) as y from pairs where b is not null)
select p_partkey, levenshtein(a, b)::bigint as edits, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) as ratio from d""")
def d9_name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance and shared tokens of a name and the one before it of the same brand."""
    from pyspark.sql import Window

    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = table(spark, sf_dir, "part").withColumn("b", before).where("b is not null")
    return pairs.select("p_partkey", F.levenshtein("p_name", "b").cast("long").alias("edits"), F.round(fn.token_set_ratio(F.col("p_name"), F.col("b")), 6).alias("ratio"))


LONGEST = "list_reduce(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x, y: case when length(y) > length(x) then y else x end)"


@plans.query(f"""with {NAMES}, t as (select *, {LONGEST.format('a')} as x, {LONGEST.format('b')} as y from pairs where b is not null),
d as (select *, case when x <> '' and y <> '' then levenshtein(x, y) / greatest(length(x), length(y)) else 1.0 end as d from t)
select p_partkey, a as p_name, b as other, round(d, 6) as distance, case when d <= 0.3 then 'keep' when d <= 0.5 then 'weak' else 'drop' end as verdict from d""")
def d11_normalised_name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of distinctive tokens and its verdict at 0.3 and 0.5."""
    from pyspark.sql import Window

    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = table(spark, sf_dir, "part").withColumn("b", before).where("b is not null")
    d = fn.name_distance(F.col("p_name"), F.col("b"))
    return pairs.select("p_partkey", "p_name", F.col("b").alias("other"), F.round(d, 6).alias("distance"), F.when(d <= 0.3, "keep").when(d <= 0.5, "weak").otherwise("drop").alias("verdict"))
