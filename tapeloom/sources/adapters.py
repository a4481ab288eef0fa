"""Market tables derived from the star-schema and event tables.

Each method of ``Tables`` returns a lazy DataFrame in the schema its operators expect.
Every derived bar key is unique, so a daily series never holds more rows than the calendar
has days; only tick tables are unbounded per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NTZ = "timestamp_ntz"
#: Line items of one symbol that one task may sort.
DEALT_ROWS = 2_000_000


def _choice(index: Column, values: list[str]) -> Column:
    """Element ``index`` (0-based) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _daily(items: DataFrame, keys: list[str], named: list[Column | str]) -> DataFrame:
    """One bar per key and day; a key holds one supplier, which is thus no part of the order of its line items."""
    priced = items.withColumns({
        "k": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "p": F.try_divide("l_extendedprice", "l_quantity"),
    })
    grouped = priced.groupBy(*keys, "day").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("turnover"),
    )
    return grouped.select(
        *named, F.lit("1d").alias("interval"), F.col("day").cast(NTZ).alias("datetime"),
        "open", "high", "low", "close", "volume", "turnover", F.lit(0.0).alias("open_interest"),
    )


class Tables:
    """Lazy market tables over one directory of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- bars and prices -------------------------------------------------------------

    def bars(self, tasks: int | None = None) -> DataFrame:
        """Daily bars: one symbol per supplier, one bar per ship day.

        With ``tasks`` the bars lie by exchange and symbol over so many tasks, for a program whose next steps go by series. The line
        items are then dealt so themselves, which moves fewer bytes than half-made bars and a second shuffle of whole ones;
        where one symbol has more than ``DEALT_ROWS`` of them (counted first), its bars are made in many tasks before they are dealt.
        """
        named = [F.col("l_suppkey").cast("string").alias("symbol"), F.when(F.col("l_suppkey") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange")]
        series = ["exchange", "symbol"]
        if tasks is None:
            return _daily(self._items("l_suppkey"), ["l_suppkey"], named)
        most = self.raw("lineitem").groupBy("l_suppkey").count().agg(F.max("count").alias("n")).first()["n"]
        if (most or 0) > DEALT_ROWS:
            return self.bars().repartition(tasks, *series)
        return _daily(self._items(*named).repartition(tasks, *series), series, ["symbol", "exchange"])

    def series_tasks(self, rows_per_task: int = 500_000) -> int:
        """Tasks for ``bars``, so that the rows of one do not grow with the table; the line items are counted from their footers."""
        rows = self.raw("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))

    def _items(self, *keys: str | Column) -> DataFrame:
        """The columns of line items that bars are made of."""
        return self.raw("lineitem").select(
            *keys, F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")

    def ticks(self) -> DataFrame:
        """Event values as single-trade bars."""
        v = F.col("value")
        return self.raw("events").select(
            F.col("event_type").alias("symbol"), F.lit("SSE").alias("exchange"),
            F.lit("tick").alias("interval"), F.col("ts").alias("datetime"),
            v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"),
            F.lit(1.0).alias("volume"), v.alias("turnover"), F.lit(0.0).alias("open_interest"),
        )

    def prices(self) -> DataFrame:
        """Research form of the daily bars."""
        return self.bars().select(
            "symbol", F.to_date("datetime").alias("trade_date"), "close", "open", "high", "low", "volume",
            F.col("turnover").alias("amount"), F.try_divide("turnover", "volume").alias("vwap"),
        )

    def adj_factor(self, shift_days: int = 0) -> DataFrame:
        """A factor on every 40th bar of a symbol; ``shift_days`` moves it off the bar days."""
        # A bar is a ship day of a supplier; the sorted days of one are at most those of the calendar.
        days = self.raw("lineitem").groupBy("l_suppkey").agg(F.collect_set(F.struct(F.to_date("l_shipdate").alias("day"))).alias("days"))
        numbered = days.select("l_suppkey", F.posexplode(F.array_sort("days")).alias("place", "d")).select("l_suppkey", "d.day", (F.col("place") + 1).alias("rn"))
        return numbered.filter(F.col("rn") % 40 == 0).select(
            F.when(F.col("l_suppkey") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"), F.col("l_suppkey").cast("string").alias("symbol"),
            F.date_add("day", shift_days).cast(NTZ).alias("datetime"), (1 + 0.01 * F.floor(F.col("rn") / 40)).alias("adj_factor"),
        )

    # ---- statements and fundamentals -------------------------------------------------

    def financials(self) -> DataFrame:
        """Quarterly statements, one per symbol and quarter."""
        ext = F.col("l_extendedprice")
        end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
        q = self.raw("lineitem").groupBy("l_suppkey", end.alias("report_date")).agg(
            F.sum(ext * (1 - F.col("l_discount"))).alias("revenue"),
            F.sum(ext * (0.2 - F.col("l_discount") - F.col("l_tax"))).alias("net_profit"),
            (F.sum(ext) + 1e6).alias("total_assets"),
        )
        assets = F.col("total_assets")
        month = F.month("report_date")
        return q.select(
            F.col("l_suppkey").cast("string").alias("symbol"),
            F.when(F.col("l_suppkey") % 2 == 0, "SSE").otherwise("SZSE").alias("exchange"),
            "report_date",
            F.date_add("report_date", (30 + F.col("l_suppkey") % 30).cast("int")).alias("publish_date"),
            F.lit("income").alias("report_type"),
            F.when(month == 12, "annual").otherwise(F.concat(F.lit("q"), (month / 3).cast("int").cast("string")))
            .alias("report_period"),
            "revenue", "net_profit", "total_assets", (assets * 0.6).alias("total_equity"),
            (assets - assets * 0.6).alias("total_liabilities"),
        )

    def ods_financial(self) -> DataFrame:
        """Raw statements: items in maps."""
        return self.financials().select(
            "symbol", "exchange", "report_date", "report_type",
            F.create_map(F.lit("total_revenue"), "revenue", F.lit("net_profit"), "net_profit").alias("raw_income"),
            F.create_map(
                F.lit("total_assets"), "total_assets", F.lit("total_liabilities"), "total_liabilities",
                F.lit("shareholders_equity"), "total_equity",
            ).alias("raw_balance"),
            F.lit("lake").alias("source"), F.lit(1.0).alias("quality_score"),
        )

    def fundamentals(self) -> DataFrame:
        """Daily valuation ratios on the bar days."""
        key = F.col("symbol").cast("bigint")
        ordinal = F.unix_date(F.to_date("datetime"))

        def ratio(mod: int) -> Column:
            return 5 + 45 * (((key * 7 + ordinal) % mod) / F.lit(float(mod)))

        return self.bars().select(
            "symbol", "exchange", F.to_date("datetime").alias("date"),
            ratio(101).alias("pe_ratio"), ratio(101).alias("pe_ttm"), ratio(103).alias("pb_ratio"),
            ratio(107).alias("ps_ratio"), (1e8 * (1 + key % 997)).alias("market_cap"),
        )

    def ods_fundamental(self) -> DataFrame:
        return self.fundamentals().select(
            "symbol", "exchange", "date",
            F.create_map(
                F.lit("pe_ratio"), "pe_ratio", F.lit("pb_ratio"), "pb_ratio", F.lit("ps_ratio"), "ps_ratio",
                F.lit("market_cap"), "market_cap", F.lit("circulating_cap"), F.col("market_cap") * 0.8,
            ).alias("raw_data"),
            F.lit("lake").alias("source"), F.lit(1.0).alias("quality_score"),
        )

    def universe(self) -> DataFrame:
        """Tradability snapshot per supplier."""
        key = F.col("s_suppkey")
        supplier = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        flags = supplier.select(
            F.lit("ALL").alias("universe"), key.cast("string").alias("symbol"),
            F.col("n_regionkey").cast("string").alias("industry"),
            (1e8 * (1 + key % 997)).alias("free_float_mkt_cap"),
            (key % 50 == 0).alias("is_st"), (key % 97 == 0).alias("is_suspended"),
            (key % 89 == 0).alias("is_limit_up"), (key % 83 == 0).alias("is_limit_down"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 700).cast("int")).alias("effective_date"),
        )
        bad = F.col("is_st") | F.col("is_suspended") | F.col("is_limit_up") | F.col("is_limit_down")
        return flags.withColumn("is_tradable", ~bad)

    # ---- events ----------------------------------------------------------------------

    def news(self) -> DataFrame:
        docs = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        sentiment = (
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
        )
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
        return docs.select(
            "doc_id", (F.col("doc_id") % 50).cast("string").alias("symbol"),
            F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"),
            day.cast(NTZ).alias("publish_date"), sentiment.alias("sentiment"),
            F.when(sentiment == "negative", -0.8).when(sentiment == "positive", 0.8).otherwise(0.0)
            .alias("sentiment_score"),
            "source", F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("confidence"),
        )

    def announcements(self) -> DataFrame:
        doc = F.col("doc_id")
        importance = (1 + doc % 5).cast("int")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 365).cast("int"))
        return self.raw("documents").select(
            "doc_id", (doc % 50).cast("string").alias("symbol"), F.substring("text", 1, 40).alias("title"),
            F.col("text").alias("content"), day.cast(NTZ).alias("announcement_date"),
            _choice(doc % 5, ["financial", "business", "governance", "risk", "other"]).alias("announcement_type"),
            "source", F.slice(F.split("text", " "), 1, 3).alias("keywords"),
            importance.alias("importance"), (importance >= 4).alias("is_important"),
        )

    def reports(self) -> DataFrame:
        key = F.col("o_orderkey")
        rating = _choice(
            F.substring("o_orderpriority", 1, 1).cast("int") - 1, ["strong_buy", "buy", "hold", "sell", "strong_sell"]
        )
        joined = (
            self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        return joined.select(
            F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 100).cast("string").alias("symbol"),
            F.concat(F.lit("Report "), key.cast("string")).alias("title"),
            F.col("o_orderdate").alias("publish_date"),
            _choice(key % 5, ["initiate", "maintain", "upgrade", "downgrade", "target"]).alias("report_type"),
            rating.alias("rating"),
            F.when(key % 7 != 0, F.col("o_totalprice") / 1000).alias("target_price"),
            (F.col("o_totalprice") / 1100).alias("current_price"), F.col("c_name").alias("analyst"),
            F.when(key % 11 == 0, "").otherwise(F.col("n_name")).alias("institution"),
        )

    def flows(self) -> DataFrame:
        price, status = F.col("o_totalprice"), F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("flow_id"), (F.col("o_custkey") % 100).cast("string").alias("symbol"),
            F.col("o_orderdate").alias("date"),
            _choice(F.col("o_orderkey") % 4, ["main", "retail", "institution", "foreign"]).alias("flow_type"),
            F.when(status == "O", "inflow").when(status == "F", "outflow").otherwise("neutral").alias("direction"),
            F.when(status == "O", price).when(status == "F", -price).otherwise(0.0).alias("net_amount"),
            F.when(status == "O", price).otherwise(0.0).alias("inflow_amount"),
            F.when(status == "F", price).otherwise(0.0).alias("outflow_amount"),
            F.lit(1.0).alias("volume"), (F.col("o_orderkey") % 10).cast("double").alias("turnover_rate"),
        )

    def themes(self) -> DataFrame:
        kind = F.col("p_type")
        theme_type = (
            F.when(kind.isin("ECONOMY", "SMALL"), "concept").when(kind.isin("LARGE", "STANDARD"), "sector")
            .when(kind == "MEDIUM", "industry").otherwise("region")
        )
        return self.raw("part").select(
            F.col("p_partkey").alias("theme_id"), (F.col("p_partkey") % 100).cast("string").alias("symbol"),
            F.col("p_brand").alias("theme_name"), theme_type.alias("theme_type"),
            (F.col("p_size") / 50.0).alias("weight"),
        )

    def top_traders(self) -> DataFrame:
        """Per symbol and day: buys (R), sells (A), both (N) and the five lowest seats of each side."""
        flag, ext = F.col("l_returnflag"), F.col("l_extendedprice")
        buy, sell = flag.isin("R", "N"), flag.isin("A", "N")
        rows = self.raw("lineitem").select(
            F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").cast(NTZ).alias("date"),
            "l_partkey", "l_quantity", F.when(buy, ext).otherwise(0.0).alias("b"),
            F.when(sell, ext).otherwise(0.0).alias("s"), buy.alias("is_buy"), sell.alias("is_sell"),
            F.try_divide("l_extendedprice", "l_quantity").alias("p"),
        )
        sums = rows.groupBy("symbol", "date").agg(
            F.sum("b").alias("buy_amount"), F.sum("s").alias("sell_amount"), F.sum("l_quantity").alias("qty"),
            F.max("p").alias("hi"), F.min("p").alias("lo"),
        )

        def seats(mask: str, name: str) -> DataFrame:
            by_seat = Window.partitionBy("symbol", "date").orderBy("l_partkey")
            first5 = rows.filter(mask).select("symbol", "date", "l_partkey").distinct().withColumn(
                "n", F.row_number().over(by_seat)
            ).filter("n <= 5")
            return first5.groupBy("symbol", "date").agg(
                F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")).alias(name)
            )

        out = sums.join(seats("is_buy", "buy_seats"), ["symbol", "date"], "left").join(
            seats("is_sell", "sell_seats"), ["symbol", "date"], "left"
        )
        empty = F.array().cast("array<string>")
        return out.select(
            "symbol", "date", F.lit("daily").alias("dragon_tiger_type"), F.lit("volume").alias("reason"),
            "buy_amount", "sell_amount", (F.col("buy_amount") - F.col("sell_amount")).alias("net_amount"),
            F.coalesce("buy_seats", empty).alias("buy_seats"), F.coalesce("sell_seats", empty).alias("sell_seats"),
            (F.col("qty") / 100).alias("turnover_rate"), F.try_divide("hi", "lo").alias("price_change"),
        )

    # ---- reference tables ------------------------------------------------------------

    def index_members(self) -> DataFrame:
        u = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("n_regionkey").cast("string").alias("index_code"), "s_suppkey", "s_name",
            (1e8 * (1 + F.col("s_suppkey") % 997)).alias("market_cap"),
        )
        totals = u.groupBy("index_code").agg(F.sum("market_cap").alias("total"))
        key = F.col("s_suppkey")
        effective = F.date_add(F.lit("1995-01-01").cast("date"), (key % 700).cast("int"))
        end = F.when(key % 5 == 0, F.date_add(effective, 400))
        return u.join(totals, "index_code").select(
            "index_code", F.concat(F.lit("Index "), "index_code").alias("index_name"),
            F.lit("sector").alias("index_type"), key.cast("string").alias("symbol"),
            F.col("s_name").alias("symbol_name"), (F.col("market_cap") / F.col("total")).alias("weight"),
            "market_cap", effective.alias("effective_date"), end.alias("end_date"), end.isNull().alias("is_active"),
        )

    def industry(self) -> DataFrame:
        """Three class rows per symbol: region, nation, and a class number within the nation."""
        s = (
            self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        region, nation = F.col("r_regionkey").cast("string"), F.col("n_nationkey").cast("string")
        seven = (F.col("s_suppkey") % 7).cast("string")

        def level(name, code, label, parent_code, parent_label) -> Column:
            return F.struct(
                F.lit(name).alias("industry_level"), code.alias("industry_code"), label.alias("industry_name"),
                parent_code.alias("parent_industry_code"), parent_label.alias("parent_industry_name"),
            )

        none = F.lit(None).cast("string")
        levels = F.array(
            level("level1", region, F.col("r_name"), none, none),
            level("level2", nation, F.col("n_name"), region, F.col("r_name")),
            level("level3", seven, F.concat(F.lit("CLASS_"), seven), nation, F.col("n_name")),
        )
        effective = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int"))
        end = F.when(F.col("s_suppkey") % 5 == 0, F.date_add(effective, 400))
        base = s.select(
            F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_name").alias("symbol_name"),
            F.lit("sw").alias("industry_standard"), effective.alias("effective_date"), end.alias("end_date"),
            F.inline(levels),
        )
        return base.withColumn("is_active", F.col("end_date").isNull())

    def macro(self) -> DataFrame:
        """Five monthly series, one per order priority."""
        index = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        monthly = self.raw("orders").groupBy(
            _choice(index, ["GDP", "CPI", "PPI", "M2", "UNEMPLOYMENT"]).alias("data_code"),
            _choice(index, ["gdp", "cpi", "ppi", "money_supply", "unemployment"]).alias("data_type"),
            F.trunc(F.to_date("o_orderdate"), "month").alias("date"),
        ).agg(F.round(F.sum("o_totalprice") / 1000, 5).alias("value"))
        order = Window.partitionBy("data_code").orderBy("date")
        prev = F.col("previous_value")
        return monthly.withColumn("previous_value", F.lag("value").over(order)).select(
            "data_code", "data_type", F.lit("monthly").alias("frequency"), "date", "value",
            F.lit("thousand").alias("unit"), "previous_value", (F.col("value") - prev).alias("change_value"),
            (F.try_divide(F.col("value") - prev, prev) * 100).alias("change_rate"),
        )

    # ---- governance ------------------------------------------------------------------

    def lineage_edges(self) -> DataFrame:
        def edge(source, target):
            return [source.alias("source_id"), target.alias("target_id"), F.lit("data_flow").alias("edge_type")]

        def node(prefix: str, key: str) -> Column:
            return F.concat(F.lit(prefix), F.col(key).cast("string"))

        return (
            self.raw("nation").select(*edge(node("r", "n_regionkey"), node("n", "n_nationkey")))
            .union(self.raw("customer").select(*edge(node("n", "c_nationkey"), node("c", "c_custkey"))))
            .union(self.raw("orders").select(*edge(node("c", "o_custkey"), node("o", "o_orderkey"))))
        )

    def lineage_nodes(self) -> DataFrame:
        def rows(table: str, prefix: str, key: str, dataset: str, kind: str) -> DataFrame:
            return self.raw(table).select(
                F.concat(F.lit(f"{dataset}_"), (F.col(key) % 25).cast("string")).alias("dataset_id"),
                F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"),
            )

        return (
            rows("region", "r", "r_regionkey", "region", "provider")
            .union(rows("nation", "n", "n_nationkey", "nation", "store"))
            .union(rows("customer", "c", "c_custkey", "customer", "service"))
            .union(rows("orders", "o", "o_orderkey", "order", "store"))
        )

    def metrics(self) -> DataFrame:
        kind, v = F.col("event_type"), F.col("value")
        return self.raw("events").select(
            F.when(kind == "error", "api_error_rate").when(kind == "view", "storage_usage_percent")
            .when(kind == "click", "data_age_hours").when(kind == "purchase", "data_quality_score")
            .otherwise("other").alias("name"),
            F.when(kind == "error", v / 5000).when(kind == "view", v / 5).when(kind == "click", v / 10)
            .when(kind == "purchase", 1 - v / 500).otherwise(v).alias("value"),
            F.col("ts").alias("timestamp"), "event_id",
        )

    def assets(self) -> DataFrame:
        return self.raw("orders").select(
            F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("asset_id"),
            F.col("o_orderdate").alias("created_at"),
            _choice(F.col("o_orderkey") % 4, ["permanent", "years_7", "years_1", "days_30"]).alias("policy_id"),
        )

    def audit(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "event_type", F.col("ts").alias("timestamp"), "user_id",
            F.get_json_object("props", "$.k").alias("asset_id"), F.col("props").alias("details"),
        )

    def bars_update(self) -> DataFrame:
        """The new side of an upsert: late-month bars restated, plus one new day per symbol."""
        bars = self.bars()
        restated = bars.filter(F.dayofmonth("datetime") >= 25).withColumn("close", F.col("close") * 1.01)
        fields = F.struct(*[F.col(c) for c in bars.columns])
        last = bars.groupBy("exchange", "symbol", "interval").agg(F.max_by(fields, "datetime").alias("b")).select("b.*")
        fresh = last.withColumn("datetime", F.date_add(F.to_date("datetime"), 1).cast(NTZ))
        return restated.unionByName(fresh.select(bars.columns))
