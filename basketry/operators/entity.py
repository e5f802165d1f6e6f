"""Product identity resolution: candidates, blocking, fuzzy pairs, clusters.

* names are normalised and blocked JVM-side (regex expressions);
* pairs are scored on *distinct* normalised names per block, so many
  barcodes sharing a name cost one comparison, not a quadratic block;
* lengths and character counts bound the distance of a pair; only pairs that
  they allow reach a sound Levenshtein prefilter (indel >= levenshtein), and
  only its survivors the exact Arrow-batched ratio UDF;
* a large block is split by length into pairs of sub-blocks, so no task
  compares a whole block, and pairs of lengths that cannot match never meet;
* clusters are connected components by star contraction over the edge table
  (joins and minima, a table in the shared folder per round), so no cluster
  is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import indel_ratio_udf, token_sorted
from ..functions.numeric import round_half_up
from ..session import saved
from .dims import distinct_names, latest_by

# ---------------------------------------------------------------------------
# Fixed values for name normalisation (must equal the source behaviour).
UNIT_FIXES = [
    (r"(\d)(KG|KGS)\b", "$1 KG"),
    (r"(\d)(GM|GMS|GR)\b", "$1 G"),
    (r"(\d)(LTR|LT|LTS|L)\b", "$1 L"),
    (r"(\d)(ML|MLS)\b", "$1 ML"),
    (r"(\d)(PCS|PC)\b", "$1 PCS"),
]
NOISE_TOKENS = ["CO", "LTD", "PVT", "MFG", "INDIA"]
CLI_MIN_SCORE = 62
API_MIN_SCORE = 78
# ---------------------------------------------------------------------------


def normalize_name(c) -> Column:
    """Upper, unit spacing, punctuation to space, noise tokens dropped."""
    s = F.upper(F.col(c) if isinstance(c, str) else c)
    for pat, rep in UNIT_FIXES:
        s = F.regexp_replace(s, "(?U)" + pat, rep)
    s = F.regexp_replace(s, r"(?U)[^\w\s\-]", " ")
    toks = F.filter(F.split(s, r"\s+"), lambda t: (t != "") & ~t.isin(NOISE_TOKENS))
    return F.array_join(toks, " ")


def block_key(norm) -> Column:
    """P25: first three characters (padded with '_') + '|' + first number."""
    n = F.col(norm) if isinstance(norm, str) else norm
    prefix = F.when(F.length(n) >= 3, F.substring(n, 1, 3)).otherwise(F.rpad(n, 3, "_"))
    return F.concat(prefix, F.lit("|"), F.regexp_extract(n, r"\d+", 0))


def candidates(items_master: DataFrame, sales_items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Newest name per raw barcode (master first, sales fallback), not yet aliased."""
    def newest(df):
        named = df.filter(F.col("item_name_raw").isNotNull() & (F.col("item_name_raw") != ""))
        if "import_batch_id" not in named.columns:
            named = named.withColumn("import_batch_id", F.lit(0).cast("long"))
        return latest_by(distinct_names(named), "barcode", ["imported_at", "import_batch_id", "item_name_raw"],
                         ["item_name_raw"], "barcode")
    im = newest(items_master).withColumnRenamed("item_name_raw", "_im")
    sf = newest(sales_items).withColumnRenamed("item_name_raw", "_sf")
    ab = im.select("barcode").union(sf.select("barcode")).distinct()
    return (ab.join(im, "barcode", "left").join(sf, "barcode", "left")
            .select("barcode", F.coalesce("_im", "_sf").alias("name"))
            .filter(F.col("name").isNotNull())
            .join(aliases.select(F.col("alias_barcode").alias("barcode")), "barcode", "left_anti"))


def blocked(cands: DataFrame) -> DataFrame:
    n = normalize_name("name")
    return cands.select("barcode", "name", n.alias("norm")).withColumn("block_key", block_key("norm"))


#: Names of one comparison part; a larger block is split into pairs of sub-blocks.
PART_NAMES = 2000
#: Groups of characters whose counts bound the distance of two names (any disjoint groups do), by mask.
BAG_GROUPS = [["A", "E", "I", "O", "U", "R", "T", "N", "S"], ["L", "C", "M", "DP", "BGHK", "FVWY", "01234", "56789", " "]]
#: Bits of a group in its mask.
BAG_BITS = 7


def split_blocks(names: DataFrame, limit: int = PART_NAMES, min_score: float = 0.0) -> DataFrame:
    """Deal the names of each block into parts (_p, _q), so that any two that can reach ``min_score`` meet in exactly one.

    A block of more than ``limit`` names is cut into sub-blocks (_sub) of that
    many by rising length, names of one length by hash. Sub-blocks whose lengths
    are too far apart for the score form no part. Cuts follow from counts by
    (block, length), which are few rows.
    """
    sized = names.withColumn("_len", F.length(token_sorted(F.col("norm"))))
    w = Window.partitionBy("block_key")
    ranks = (sized.groupBy("block_key", "_len").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_all", F.sum("_n").over(w))
             .withColumn("_before", F.sum("_n").over(w.orderBy("_len")) - F.col("_n"))
             .where(F.col("_all") > limit).drop("_all"))
    cut = lambda position: F.floor(position / limit).cast("int")
    subs = (ranks.withColumn("_sub", F.explode(F.sequence(cut(F.col("_before")), cut(F.col("_before") + F.col("_n") - 1))))
            .groupBy("block_key", "_sub").agg(F.min("_len").alias("_lo"), F.max("_len").alias("_hi")))
    p = subs.select("block_key", F.col("_sub").alias("_p"), F.col("_hi").alias("_la"))
    q = subs.select("block_key", F.col("_sub").alias("_q"), F.col("_lo").alias("_lb"))
    parts = (p.join(q, "block_key").where("_p <= _q")
             .where(within(F.col("_lb") - F.col("_la"), F.col("_la"), F.col("_lb"), min_score))
             .select("block_key", "_p", "_q"))
    meets = (parts.withColumn("_sub", F.col("_p"))
             .unionByName(parts.where("_p < _q").withColumn("_sub", F.col("_q"))))
    place = cut(F.col("_before") + F.pmod(F.xxhash64("norm"), F.col("_n")))
    return (sized.join(ranks, ["block_key", "_len"], "left").withColumn("_sub", F.coalesce(place, F.lit(0)))
            .join(meets, ["block_key", "_sub"], "left")
            .withColumn("_p", F.coalesce("_p", "_sub")).withColumn("_q", F.coalesce("_q", "_sub"))
            .drop("_len", "_n", "_before"))


def within(distance: Column, la: Column, lb: Column, min_score: float) -> Column:
    """Whether a lower bound of the indel distance still allows ``min_score``.

    score >= t  <=>  indel * 100 <= (100 - t) * (la + lb). Scaled to integers
    (plus a margin), so rounding can never drop a qualifying pair.
    """
    budget = F.lit(100.0 - float(min_score)) * (la + lb).cast("double") + F.lit(1e-6)
    return (distance * 100).cast("double") <= budget


def bag(c: Column) -> list[Column]:
    """Masks of a text's character counts: a group's lowest bits are as many as its characters, BAG_BITS at most.

    The bits in which two masks differ are at most the difference of the counts.
    """
    def ones(group: str) -> Column:
        count = F.least(F.length(c) - F.length(F.translate(c, group, "")), F.lit(BAG_BITS))
        return (F.pow(F.lit(2.0), count) - 1).cast("long")
    return [sum((ones(g) * F.lit(1 << BAG_BITS * i) for i, g in enumerate(groups)), F.lit(0).cast("long"))
            for groups in BAG_GROUPS]


def bounded_pairs(blk: DataFrame, min_score: float, limit: int = PART_NAMES) -> DataFrame:
    """Distinct-name pairs inside each block that lengths and character counts allow to score ``min_score``.

    An insertion or deletion changes one character count by one, so the
    summed differences of the counts are at most the indel distance. Names are
    few bytes and much work, so the parts go to as many tasks as the session
    has shuffle partitions, neither coalesced nor broadcast by size.
    """
    names, masks = blk.select("block_key", "norm").distinct(), [f"_g{i}" for i in range(len(BAG_GROUPS))]
    dealt = split_blocks(names, limit, min_score).withColumn("_ts", token_sorted(F.col("norm")))
    dealt = dealt.select("*", F.length("_ts").alias("_l"), *[m.alias(n) for n, m in zip(masks, bag(F.col("_ts")))])
    part, tasks = ["block_key", "_p", "_q"], int(blk.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda at, s: dealt.where(F.col("_sub") == F.col(at)).select(
        *part, F.col("norm").alias(f"_n{s}"), F.col("_ts").alias(f"ts_{s}"), *[F.col(m).alias(m + s) for m in ["_l", *masks]])
    la, lb = F.col("_la"), F.col("_lb")
    apart = sum((F.bit_count(F.col(m + "a").bitwiseXOR(F.col(m + "b"))) for m in masks), F.lit(0))
    return (side("_p", "a").repartition(tasks, *part).hint("merge").join(side("_q", "b"), part)
            .filter((F.col("_p") < F.col("_q")) | (F.col("_na") < F.col("_nb")))
            .filter(within(F.abs(la - lb), la, lb, min_score))
            .filter(within(apart, la, lb, min_score))
            .select("block_key", "_na", "_nb", "ts_a", "ts_b"))


def name_pairs(blk: DataFrame, min_score: float, limit: int = PART_NAMES) -> DataFrame:
    """Distinct-name pairs inside each block scoring >= ``min_score``."""
    la, lb = F.length("ts_a"), F.length("ts_b")
    cand = bounded_pairs(blk, min_score, limit).filter(within(F.levenshtein("ts_a", "ts_b"), la, lb, min_score))
    return (cand.withColumn("score", indel_ratio_udf("ts_a", "ts_b"))
            .filter(F.col("score") >= F.lit(float(min_score)))
            .select("block_key", F.least("_na", "_nb").alias("norm_a"), F.greatest("_na", "_nb").alias("norm_b"), "score"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label) with label = smallest node of its component.

    Alternating large-star and small-star rounds: every node hands its larger
    neighbours, then itself and its smaller ones, to the smallest it knows. A
    chain of n nodes takes about log n rounds. Each round takes a minimum per
    node (pre-aggregated) and joins it back; the edges of a round are a table
    in the shared folder.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).distinct()
    e = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    e = saved(e, "edges")
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = saved(small, "edges")
        before, seen = seen, mark(e)
        if before == seen:
            break
    return nodes.join(e.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("label"))


def name_clusters(cands: DataFrame, products: DataFrame,
                  min_score: float = CLI_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Cluster membership (one row per barcode in a multi-barcode cluster) and the scored edges.

    Canonical = smallest barcode that has a products row, else the smallest.
    """
    blk = blocked(cands)
    edges = saved(name_pairs(blk, min_score), "name-edges")  # scored once, read by clusters and suggestions
    comp = connected_components(edges, "norm_a", "norm_b")
    members = (blk.join(comp.withColumnRenamed("node", "norm"), "norm", "left")
               .withColumn("_comp", F.coalesce(F.col("label"), F.col("norm"))).drop("label"))
    app = products.select("barcode", F.lit(True).alias("_app"))
    m = members.join(app, "barcode", "left")
    canon = (m.groupBy("_comp").agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.min(F.when(F.col("_app"), F.col("barcode"))), F.min("barcode")).alias("cluster_key"))
        .filter(F.col("_n") > 1))
    return (m.join(canon, "_comp").select(
        "cluster_key", "barcode", "name", "norm", "block_key",
        (F.col("barcode") == F.col("cluster_key")).alias("is_canonical")), edges)


def merge_suggestions(clusters: DataFrame, edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """D3: (alias -> canonical) suggestions with the direct pair score (0 if only transitive).

    With an ``existing`` suggestions table, reviewed rows are kept untouched
    and pending ones are replaced (S26 upsert semantics).
    """
    canon = clusters.filter("is_canonical").select(
        "cluster_key", F.col("name").alias("canonical_name"), F.col("norm").alias("_cnorm"))
    al = clusters.filter(~F.col("is_canonical")).select(
        "cluster_key", F.col("barcode").alias("alias_barcode"), F.col("name").alias("alias_name"),
        F.col("norm").alias("_anorm"))
    e = edges.select(F.col("norm_a").alias("_x"), F.col("norm_b").alias("_y"), "score")
    j = al.join(canon, "cluster_key")
    lo, hi = F.least("_anorm", "_cnorm"), F.greatest("_anorm", "_cnorm")
    j = j.withColumn("_x", lo).withColumn("_y", hi).join(e, ["_x", "_y"], "left")
    score = F.when(F.col("_anorm") == F.col("_cnorm"), F.lit(100.0)).otherwise(F.coalesce("score", F.lit(0.0)))
    out = j.select("cluster_key", "alias_barcode", F.col("cluster_key").alias("canonical_candidate"),
                   "alias_name", "canonical_name", round_half_up(score, 2).alias("similarity_score"),
                   F.lit("pending").alias("status"))
    if existing is not None:
        reviewed = existing.filter(F.col("status") != "pending").select(*out.columns)
        out = out.join(reviewed.select("alias_barcode", "canonical_candidate"),
                       ["alias_barcode", "canonical_candidate"], "left_anti").unionByName(reviewed)
    return out


def suggestion_clusters(suggestions: DataFrame, status: str = "pending", min_score: float = 0.0,
                        limit: int | None = None, offset: int = 0) -> DataFrame:
    """Per-cluster summary, best score first; ``limit`` / ``offset`` ask for one page of it."""
    s = suggestions.filter((F.col("status") == status) & (F.col("similarity_score") >= min_score))
    out = (s.groupBy("cluster_key", "canonical_candidate", "canonical_name")
           .agg(F.count(F.lit(1)).alias("member_count"), F.min("similarity_score").alias("min_score"),
                F.max("similarity_score").alias("max_score"))
           .orderBy(F.col("max_score").desc(), "cluster_key"))
    return out.offset(offset).limit(limit) if limit is not None else out.offset(offset) if offset else out


def suggestion_members(suggestions: DataFrame, page: DataFrame, status: str = "pending",
                       min_score: float = 0.0) -> DataFrame:
    """The members of the clusters on a page, one row each (a cluster may be large, so no list)."""
    s = suggestions.filter((F.col("status") == status) & (F.col("similarity_score") >= min_score))
    keep = page.select("cluster_key", "member_count", "max_score")
    return s.join(keep, "cluster_key").select(
        "cluster_key", "member_count", "max_score", "alias_barcode", "alias_name", "canonical_candidate",
        "canonical_name", "similarity_score")


def alias_violations(aliases: DataFrame) -> DataFrame:
    """Canonicals that are themselves aliases, and aliases used as canonicals."""
    a = aliases.select("alias_barcode", "canonical_barcode")
    as_alias = a.select(F.col("alias_barcode").alias("canonical_barcode")).distinct()
    as_canon = a.select(F.col("canonical_barcode").alias("alias_barcode")).distinct()
    v1 = a.join(as_alias, "canonical_barcode", "left_semi").withColumn("reason", F.lit("canonical_is_alias"))
    v2 = a.join(as_canon, "alias_barcode", "left_semi").withColumn("reason", F.lit("alias_is_canonical"))
    return v1.unionByName(v2)


def alias_list(aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Aliases with the canonical product's name."""
    p = products.select(F.col("barcode").alias("canonical_barcode"), "canonical_name")
    return aliases.join(p, "canonical_barcode", "left").select(
        "alias_barcode", "canonical_barcode", "canonical_name",
        F.col("similarity_score").cast("double").alias("similarity_score"), "confirmed_at", "notes")


def entity_product_facts(items_master: DataFrame, sales_items: DataFrame) -> DataFrame:
    """Per barcode, newest master row + total sold + last sold timestamp."""
    from ..functions.cleaning import export_timestamp
    cols = ["item_name_raw", "brand_raw", "mrp", "purchase_price", "rate", "size_raw", "expiry_date_raw",
            "hsn_code", "system_stock_snapshot"]
    m = items_master if "import_batch_id" in items_master.columns else items_master.withColumn(
        "import_batch_id", F.lit(0).cast("long"))
    master = latest_by(m, "barcode", ["imported_at", "import_batch_id"], cols, "barcode")
    sales = sales_items.groupBy("barcode").agg(
        F.sum(F.coalesce("sale_qty", F.lit(0).cast("decimal(18,4)"))).cast("double").alias("total_sales_qty"),
        F.max(export_timestamp("sale_datetime_raw")).alias("last_sold"))
    return master.join(sales, "barcode", "left").select(
        "barcode", F.col("item_name_raw").alias("item_name"), F.col("brand_raw").alias("brand"),
        F.col("mrp").cast("double").alias("mrp"), F.col("purchase_price").cast("double").alias("purchase_price"),
        F.col("rate").cast("double").alias("rate"), F.col("size_raw").alias("size"),
        F.col("expiry_date_raw").alias("expiry_date"), "hsn_code",
        F.col("system_stock_snapshot").cast("double").alias("system_stock"),
        F.coalesce("total_sales_qty", F.lit(0.0)).alias("total_sales_qty"), "last_sold")
