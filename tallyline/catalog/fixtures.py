"""Entity-game facts, ticket legs and quoted lines derived from the benchmark tables.

Every fixture is given twice: as a DataFrame and as the SQL of the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import heavy_keys
from ..operators.legs import leg_table, ticket_table
from ..session import stored, stored_dealt, tasks_for

SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_tasks(spark: SparkSession, folder: str) -> int | None:
    """In how many tasks line items are dealt by order, or nothing where an order alone holds more than a task's share.

    The count comes from the files' footers.  Without it a task groups whatever one split of a file or one shuffle
    partition holds: some million short rows.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey")
    tasks = tasks_for(spark, lines.count())
    return None if heavy_keys(lines.dropna(), ["l_orderkey"], tasks) else tasks


def sold(spark: SparkSession, folder: str, tasks: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Line items with their order, dealt by order to `tasks` tasks, or as Spark would if 0; what `order_tasks` says if not given."""
    lines, orders = table(spark, folder, "lineitem") if lines is None else lines, table(spark, folder, "orders")
    tasks = order_tasks(spark, folder) if tasks is None else tasks
    if tasks:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


SQL["box"] = """
SELECT l_orderkey AS game_id, l_suppkey AS player_id, CAST(o_orderdate AS DATE) AS game_date,
       CASE WHEN o_orderstatus = 'O' THEN 'H' ELSE 'A' END AS home_away,
       SUM(l_quantity) AS pts, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS fg3m,
       CAST(COUNT(*) AS DOUBLE) AS ast, CAST(SUM(l_linenumber) AS DOUBLE) AS reb, MAX(l_quantity) AS minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_orderkey, l_suppkey, CAST(o_orderdate AS DATE), CASE WHEN o_orderstatus = 'O' THEN 'H' ELSE 'A' END
"""


def box(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """Game log: one row per order (game) and supplier (player)."""
    return sold(spark, folder, tasks).groupBy(
        F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.when(F.col("o_orderstatus") == "O", "H").otherwise("A").alias("home_away"),
    ).agg(
        F.sum("l_quantity").alias("pts"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("fg3m"),
        F.count(F.lit(1)).cast("double").alias("ast"), F.sum("l_linenumber").cast("double").alias("reb"),
        F.max("l_quantity").alias("minutes"))


SQL["legs"] = """
SELECT l_orderkey AS builder_id,
       CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
         || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round_even(l_discount * 100, 0) AS BIGINT) AS VARCHAR) || '-'
         || CAST(CAST(round_even(l_tax * 100, 0) AS BIGINT) AS VARCHAR) AS leg_id,
       l_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, l_suppkey AS player_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'pts' WHEN 1 THEN 'fg3m' WHEN 2 THEN 'ast' WHEN 3 THEN 'reb' ELSE 'blk' END AS stat,
       CASE WHEN l_linestatus = 'O' THEN 'Over' ELSE 'under' END AS direction,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
            WHEN l_linenumber % 5 = 0 THEN 25.5 WHEN l_linenumber % 5 = 1 THEN 0.5 WHEN l_linenumber % 5 = 2 THEN 1.0 ELSE 0.0 END
         AS line,
       1 + 10 * l_discount AS builder_total_odds, CASE WHEN l_tax = 0 THEN NULL ELSE 1 + l_tax END AS stake
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def legs(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """Ticket legs: one per line item, the order being both ticket and game."""
    n = F.col("l_linenumber")
    return sold(spark, folder, tasks).select(
        F.col("l_orderkey").alias("builder_id"),
        F.concat_ws("-", n.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("bigint").cast("string"), F.rint(F.col("l_discount") * 100).cast("bigint").cast("string"),
                    F.rint(F.col("l_tax") * 100).cast("bigint").cast("string")).alias("leg_id"),
        F.col("l_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.col("l_suppkey").alias("player_id"),
        F.when(n % 5 == 0, "pts").when(n % 5 == 1, "fg3m").when(n % 5 == 2, "ast").when(n % 5 == 3, "reb").otherwise("blk").alias("stat"),
        F.when(F.col("l_linestatus") == "O", "Over").otherwise("under").alias("direction"),
        F.when(n % 3 == 0, None).when(n % 5 == 0, 25.5).when(n % 5 == 1, 0.5).when(n % 5 == 2, 1.0).otherwise(0.0).alias("line"),
        (1 + 10 * F.col("l_discount")).alias("builder_total_odds"),
        F.when(F.col("l_tax") == 0, None).otherwise(1 + F.col("l_tax")).alias("stake"))


SQL["quoted"] = """
SELECT l_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, l_suppkey AS player_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'pts' WHEN 1 THEN 'fg3m' WHEN 2 THEN 'ast' ELSE 'reb' END AS stat,
       CAST(p_size - 0.5 * (l_linenumber % 2) AS DOUBLE) AS line, 1.5 + 10 * l_discount AS over_odds, 1.5 + 10 * l_tax AS under_odds, p_brand AS book
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def quoted(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    """Quoted lines: half and whole lines, several books for some keys.

    Parts come first: joined afterwards, they would deal the line items by part once they are too many to broadcast.
    """
    part, n = table(spark, folder, "part"), F.col("l_linenumber")
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return sold(spark, folder, tasks, lines).select(
        F.col("l_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.col("l_suppkey").alias("player_id"),
        F.when(n % 4 == 0, "pts").when(n % 4 == 1, "fg3m").when(n % 4 == 2, "ast").otherwise("reb").alias("stat"),
        (F.col("p_size") - 0.5 * (n % 2)).alias("line"), (1.5 + 10 * F.col("l_discount")).alias("over_odds"),
        (1.5 + 10 * F.col("l_tax")).alias("under_odds"), F.col("p_brand").alias("book"))


SQL["games"] = """
SELECT o_orderkey AS "gameId", o_custkey AS "personId", c_name AS player_name, n_name AS player_team, r_name AS conference,
       CAST(o_orderdate AS DATE) AS game_date_only, o_orderstatus = 'F' AS win, o_orderpriority <= '2-HIGH' AS home,
       SUM(l_quantity) AS "PTS", CAST(COUNT(*) AS DOUBLE) AS "AST", CAST(SUM(l_linenumber) AS DOUBLE) AS "REB",
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS "FG3M",
       CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS "STL",
       CAST(SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS "BLK",
       CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS "TOV",
       MAX(l_quantity) AS minutes_played, CAST(SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / 8.0 AS "FG_PCT",
       CAST(SUM(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS DOUBLE) / 8.0 AS "FG3_PCT", MIN(l_quantity) / 64.0 AS "FT_PCT",
       SUM(l_quantity) - 100 AS "PLUS_MINUS"
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY o_orderkey, o_custkey, c_name, n_name, r_name, CAST(o_orderdate AS DATE), o_orderstatus, o_orderpriority
"""


def games(spark: SparkSession, folder: str) -> DataFrame:
    """Season facts: one row per order, the customer being the player and the nation the team."""
    t = {n: table(spark, folder, n) for n in ("orders", "lineitem", "customer", "nation", "region")}

    def count_if(condition):
        return F.count_if(condition).cast("double")

    per_game = t["lineitem"].groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("PTS"), F.count(F.lit(1)).cast("double").alias("AST"),
        F.sum("l_linenumber").cast("double").alias("REB"),
        count_if(F.col("l_returnflag") == "R").alias("FG3M"), count_if(F.col("l_returnflag") == "A").alias("STL"),
        count_if(F.col("l_returnflag") == "N").alias("BLK"), count_if(F.col("l_linestatus") == "F").alias("TOV"),
        F.max("l_quantity").alias("minutes_played"), (count_if(F.col("l_discount") > 0.05) / 8.0).alias("FG_PCT"),
        (count_if(F.col("l_tax") > 0.04) / 8.0).alias("FG3_PCT"), (F.min("l_quantity") / 64.0).alias("FT_PCT"),
        (F.sum("l_quantity") - 100).alias("PLUS_MINUS"))
    return (
        t["orders"].join(per_game, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("o_orderkey").alias("gameId"), F.col("o_custkey").alias("personId"), F.col("c_name").alias("player_name"),
                F.col("n_name").alias("player_team"), F.col("r_name").alias("conference"), F.to_date("o_orderdate").alias("game_date_only"),
                (F.col("o_orderstatus") == "F").alias("win"), (F.col("o_orderpriority") <= "2-HIGH").alias("home"),
                *[c for c in per_game.columns if c != "l_orderkey"])
    )


SQL["ev"] = """
SELECT event_id, ts, CAST(ts AS DATE) AS game_date, user_id AS player_id, event_type AS stat, round_even(value * 100, 0) AS value
FROM events
"""


def ev(spark: SparkSession, folder: str) -> DataFrame:
    """Event facts: the user is the player, the event type the stat, the value in whole hundredths."""
    return table(spark, folder, "events").select(
        "event_id", "ts", F.to_date("ts").alias("game_date"), F.col("user_id").alias("player_id"), F.col("event_type").alias("stat"),
        F.rint(F.col("value") * 100).alias("value"))


SQL["night_box"] = """
SELECT CAST(ts AS DATE) AS game_date_only, 'u' || CAST(user_id AS VARCHAR) AS player_name, MIN(event_id) AS "gameId",
       CAST(SUM(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS DOUBLE) AS "PTS",
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS "AST", CAST(COUNT(*) AS DOUBLE) AS "REB",
       SUM(round_even(value, 0)) AS "MIN"
FROM events GROUP BY CAST(ts AS DATE), user_id
"""


def night_box(spark: SparkSession, folder: str) -> DataFrame:
    """Nightly box score per user."""
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy(
        F.to_date("ts").alias("game_date_only"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("player_name")).agg(
        F.min("event_id").alias("gameId"), F.count_if(kind.isin("click", "view")).cast("double").alias("PTS"),
        F.count_if(kind == "purchase").cast("double").alias("AST"), F.count(F.lit(1)).cast("double").alias("REB"),
        F.sum(F.rint("value")).alias("MIN"))


SQL["scored"] = """
SELECT l.doc_id, quality AS y, lang, source, CAST(n_chars AS DOUBLE) / (SELECT MAX(n_chars) FROM documents) AS p,
       1 + 0.5 * (l.doc_id % 8) AS decimal_odds, 1.0 + l.doc_id % 4 AS stake
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier scores: document quality against relative length."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    top = docs.agg(F.max("n_chars")).scalar()
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), "lang", "source", (F.col("n_chars").cast("double") / top).alias("p"),
        (1 + 0.5 * (F.col("doc_id") % 8)).alias("decimal_odds"), (1.0 + F.col("doc_id") % 4).alias("stake"))


# Settled tickets: legs joined to results and lines, rolled up.
SQL["leg_rows"] = """
SELECT *, lower(direction) AS direction_lower,
       CASE WHEN lower(direction) = 'over' THEN CAST(COALESCE(realised > effective_line, FALSE) AS INTEGER)
            ELSE CAST(COALESCE(realised < effective_line, FALSE) AS INTEGER) END AS leg_hit,
       realised - effective_line AS realised_minus_line,
       (realised - effective_line) / NULLIF(effective_line, 0) * 100 AS realised_pct_diff
FROM (
  SELECT g.*, q.line AS line_book, q.over_odds, q.under_odds, COALESCE(g.line, q.line) AS effective_line,
         CASE g.stat WHEN 'pts' THEN pts WHEN 'fg3m' THEN fg3m WHEN 'ast' THEN ast WHEN 'reb' THEN reb END AS realised
  FROM (SELECT legs.*, pts, fg3m, ast, reb FROM legs LEFT JOIN box USING (game_id, game_date, player_id)) g
  LEFT JOIN quoted q ON g.game_id = q.game_id AND g.game_date = q.game_date AND g.player_id = q.player_id AND g.stat = q.stat
) j
"""

SQL["tickets"] = """
SELECT r.*, 1.0 / NULLIF(decimal_odds, 0) AS book_implied_prob, CAST(n_over AS DOUBLE) / n_legs AS pct_over,
       CAST(n_under AS DOUBLE) / n_legs AS pct_under, CAST(n_over = n_legs AS INTEGER) AS is_all_over,
       CAST(n_under = n_legs AS INTEGER) AS is_all_under, CAST(n_over > 0 AND n_under > 0 AS INTEGER) AS is_mixed,
       has_pts + has_fg3m + has_ast + has_reb AS n_unique_stats
FROM (
  SELECT builder_id, MIN(game_date) AS game_date, MIN(game_id) AS game_id, COUNT(DISTINCT leg_id) AS n_legs, MIN(leg_hit) AS builder_hit,
         AVG(ABS(realised_minus_line)) AS mean_abs_edge, MAX(ABS(realised_minus_line)) AS max_abs_edge,
         COALESCE(arg_min(stake, leg_id) FILTER (WHERE stake IS NOT NULL), 1.0) AS stake, arg_min(builder_total_odds, leg_id) AS decimal_odds,
         SUM(CASE WHEN direction_lower = 'over' THEN 1 ELSE 0 END) AS n_over,
         SUM(CASE WHEN direction_lower = 'under' THEN 1 ELSE 0 END) AS n_under,
         MAX(CASE WHEN stat = 'pts' THEN 1 ELSE 0 END) AS has_pts, MAX(CASE WHEN stat = 'fg3m' THEN 1 ELSE 0 END) AS has_fg3m,
         MAX(CASE WHEN stat = 'ast' THEN 1 ELSE 0 END) AS has_ast, MAX(CASE WHEN stat = 'reb' THEN 1 ELSE 0 END) AS has_reb,
         COUNT(DISTINCT player_id) AS n_unique_players, COUNT(player_id) AS n_total_legs
  FROM leg_rows GROUP BY builder_id) r
"""

TICKET_FIXTURES = ("box", "legs", "quoted", "leg_rows", "tickets")


def leg_rows(spark: SparkSession, folder: str, tasks: int | None = None) -> DataFrame:
    tasks = (order_tasks(spark, folder) or 0) if tasks is None else tasks
    return leg_table(legs(spark, folder, tasks), box(spark, folder, tasks), quoted(spark, folder, tasks))


def by_ticket(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `work` makes of the leg rows of each ticket, stored.

    Legs, results, quotes and tickets meet where line items were dealt by order, so that nothing moves after that.  An order
    that holds more than a task's share is left to plain joins, which part it by player and stat.
    """
    tasks = order_tasks(spark, folder) or 0
    if tasks > spark.sparkContext.defaultParallelism:  # Spark raises smaller counts on either side of some joins
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = work(leg_rows(spark, folder, tasks))
    return stored_dealt(made) if tasks else stored(made)


def tickets(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Settled tickets, stored; only the named columns if any are named."""
    return by_ticket(spark, folder, lambda rows: ticket_table(rows).select(*(columns or ["*"])))


# Leg rows settled against the quotes of one book.
SQL["quoted_one"] = "SELECT * FROM quoted WHERE book = 'Brand#7'"
SQL["leg_rows_one"] = SQL["leg_rows"].replace("LEFT JOIN quoted q", "LEFT JOIN quoted_one q")
