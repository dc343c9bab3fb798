"""A selection of documents in which each source has its target share of all tokens.

Iterative proportional fitting rakes the tokens of the cells (source, language, topic) to the sources'
target shares and to the languages' and topics' shares in the corpus; the fitted tokens over those that
a cell has are its documents' expected number of uses, which a source's max_repeats bounds. Documents
are then sampled by these probabilities, with one factor per source that makes its total come out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import with_tokens
from strandline.session import new_folder, written

#: Slices of the sampling order in which a source's tokens are counted before one slice is looked into.
SLICES = 4096
#: Topics with less than this share of all tokens have one margin together, so a table has at most
#: sources x 13 languages x (1 / share + 1) cells.
RARE = 0.0005
#: Cells' uses are broadcast up to so many rows; beyond, they are joined by their keys.
BROADCAST_ROWS = 200_000
# Three-letter codes of languages whose two-letter codes are in use.
THREE = dict(x.split("=") for x in "eng=en fra=fr fre=fr por=pt spa=es deu=de ger=de swa=sw rus=ru ara=ar hin=hi zho=zh chi=zh jpn=ja tha=th".split())


def language(label):
    """A language label in its two-letter form; what names no language is ``und``."""
    short = F.lower(F.regexp_extract(F.trim(F.coalesce(label, F.lit(""))), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    short = F.coalesce(known[short], short)
    return F.when(short.isin(*sorted(set(THREE.values()))), short).otherwise("und")


def fit(have: np.ndarray, source: np.ndarray, others: list[np.ndarray], share: np.ndarray, most: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Expected uses of each cell's documents.

    ``have``: tokens of each cell; ``source`` and ``others``: its category in each dimension; ``share``
    and ``most``: target share and greatest number of uses of each source. The total is the largest for
    which every source can give its share; the other dimensions keep their shares of the sources' own
    mean, as far as the bounds allow; the sources' totals are met exactly.
    """
    tokens = np.bincount(source, have, len(share))
    able = (share > 0) & (tokens > 0)
    if not able.any():
        return np.zeros(len(have))
    total = float(np.min(most[able] * tokens[able] / share[able]))
    goal = np.where(able, share * total, 0.0)
    # margins of the other dimensions: what each source would give if it were sampled evenly
    even = have * np.where(tokens > 0, goal / np.maximum(tokens, 1), 0.0)[source]
    natural = have * (goal > 0)[source]
    natural = natural * even.sum() / max(natural.sum(), 1.0)
    margins = [np.bincount(o, natural) for o in others]
    bound, x = most[source] * have * (goal > 0)[source], even.copy()
    for _ in range(rounds):
        before = x.copy()
        for o, m in zip(others, margins):
            x = np.minimum(x * np.divide(m, np.bincount(o, x, len(m)), out=np.ones_like(m), where=np.bincount(o, x, len(m)) > 0)[o], bound)
        for _ in range(20):  # the sources last, with what their bounds take away given to their other cells
            now = np.bincount(source, x, len(share))
            x = np.minimum(x * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[source], bound)
            if np.allclose(np.bincount(source, x, len(share)), goal, rtol=1e-9):
                break
        if np.abs(x - before).max() <= 1e-6 * max(1.0, x.max()):
            break
    return np.divide(x, have, out=np.zeros_like(x), where=have > 0)


def mixed(documents: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats, target_share, reached_share).

    A document's topic is the sector of the node it is about. Every source's tokens miss its target by
    less than one document. Documents without tokens or source are in no mix; a repeated row counts as
    a document of its own with its own draw. Targets of null or zero share take nothing.
    """
    spark = documents.sparkSession
    folder = new_folder(spark, "mixing")
    wanted = targets.where("target_share > 0 and source is not null").select("source").distinct()
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", language(F.col("lang")).alias("language"), F.coalesce("uid", F.lit("")).alias("uid"), "text").join(wanted, "source", "left_semi")
    sectors = nodes.where("uid is not null").groupBy("uid").agg(F.min("sector").alias("topic"))
    sized = with_tokens(rows).where("tokens > 0").join(sectors, "uid", "left").select("doc_id", "source", "language", F.coalesce("topic", F.lit("none")).alias("topic"), "tokens")
    # equal rows are counted, then told apart by their number: draws don't depend on where a row is read
    sized = written(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies")), folder, "sized").withColumn("item", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")
    topics = sized.groupBy("topic").agg(F.sum("tokens").alias("t"))
    usual = [r["topic"] for r in topics.where(F.col("t") >= RARE * F.lit(topics.agg(F.sum("t")).collect()[0][0] or 0)).collect()]
    sized = sized.withColumn("topic", F.when(F.col("topic").isin(*usual), F.col("topic")).otherwise("rare"))
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("have")).collect()
    aims = targets.where("target_share > 0 and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("most")).collect()
    codes = lambda values: np.unique(np.array(values), return_inverse=True)
    plan = []
    if cells:
        names, source = codes([c["source"] for c in cells])
        others = [codes([c[d] for c in cells])[1] for d in ("language", "topic")]
        have = np.array([c["have"] for c in cells], float)
        for mix in sorted({a["mix_id"] for a in aims}):
            own = {a["source"]: a for a in aims if a["mix_id"] == mix}
            share = np.array([own[s]["share"] if s in own else 0.0 for s in names])
            most = np.array([own[s]["most"] if s in own else 0 for s in names], float)
            for c, uses in zip(cells, fit(have, source, others, share, most)):
                if uses > 0:
                    plan.append((mix, c["source"], c["language"], c["topic"], float(uses), float(own[c["source"]]["share"]), int(own[c["source"]]["most"]), float(uses * c["have"])))
    uses = spark.createDataFrame(plan, "mix_id int, source string, language string, topic string, uses double, target_share double, most int, wanted double")
    goals = uses.groupBy("mix_id", "source").agg(F.sum("wanted").alias("goal"))
    drawn = sized.join(F.broadcast(uses) if len(plan) <= BROADCAST_ROWS else uses, ["source", "language", "topic"])
    whole = F.floor("uses")
    chance = F.col("uses") - F.col("whole")
    # a document's place in the sampling order: those before 1 would be drawn by its chance alone
    place = (F.pmod(F.xxhash64("doc_id", "item", "mix_id"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    drawn = drawn.withColumn("whole", whole.cast("int")).withColumn("place", F.when((chance > 1e-9) & (F.col("whole") < F.col("most")), place / chance)).drop("uses", "wanted")
    drawn = drawn.withColumn("slice", F.when(F.col("place").isNotNull(), F.least(F.lit(SLICES - 1), F.floor(F.col("place") * (SLICES // 4)))).cast("int"))
    drawn = written(drawn, folder, "drawn")
    fixed = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("whole")).alias("fixed"))
    slices = drawn.where("slice is not null").groupBy("mix_id", "source", "slice").agg(F.sum("tokens").alias("t"))
    upto = Window.partitionBy("mix_id", "source").orderBy("slice")
    slices = slices.withColumn("before", F.sum("t").over(upto) - F.col("t"))
    edges = slices.join(goals, ["mix_id", "source"]).join(fixed, ["mix_id", "source"]).withColumn("want", F.col("goal") - F.col("fixed")).where("before < want").groupBy("mix_id", "source").agg(F.max("slice").alias("edge"), F.max_by(F.col("want") - F.col("before"), "slice").alias("rest"))
    drawn = drawn.join(F.broadcast(edges), ["mix_id", "source"], "left")
    sure = drawn.where("slice is null or edge is null or slice <> edge").withColumn("more", F.coalesce((F.col("slice") < F.col("edge")).cast("int"), F.lit(0)))
    # one slice of a source holds about a thousandth of it; it is split in order
    within = Window.partitionBy("mix_id", "source").orderBy("place", "doc_id", "item")
    split = drawn.where("slice = edge").withColumn("run", F.sum("tokens").over(within)).withColumn("more", (F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int")).drop("run")
    chosen = sure.unionByName(split).withColumn("repeats", F.col("whole") + F.col("more")).where("repeats > 0").select("mix_id", "source", "doc_id", "tokens", "repeats", "target_share")
    sums = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    all_used = sums.groupBy("mix_id").agg(F.sum("used").alias("total"))
    shares = sums.join(all_used, "mix_id").select("mix_id", "source", (F.col("used") / F.col("total")).alias("reached_share"))
    return chosen.join(F.broadcast(shares), ["mix_id", "source"])


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, reached_share, tokens, most_repeats): the report of ``mixed``."""
    used = mix.groupBy("mix_id", "source").agg(F.first("reached_share").alias("reached_share"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    aims = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    return aims.join(used, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
