"""Sets of shingles go only to the cells that verify a pair with them."""
from pyspark.sql import functions as F

from veracity.llm import hyperminhash as h


def test_sets_follow_the_pairs(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {1: words, 2: words[:190] + ["x"], 3: words[:20] + [f"y{i}" for i in range(200)], 4: words[:19] + [f"z{i}" for i in range(220)],
             5: words[5:] + [f"v{i}" for i in range(3)]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    settings = h.Settings(shingle=4)
    rows = h.sketched(docs, settings).localCheckpoint()
    nodes = rows.select("doc_id", "text_hash", "digest", F.col("doc_id").alias("node"))
    sets = h.node_sets(docs, nodes, settings, "doc_id", "text").localCheckpoint()
    sketches = rows.select(F.col("doc_id").alias("node"), "n").join(sets.select("node", "registers"), "node").withColumn("shared", F.col("n"))
    # every node is in every band of the others too, as if far more bands were shared; 5 is already linked with 1
    members = rows.select(F.explode("keys").alias("key")).distinct().crossJoin(rows.select(F.col("doc_id").alias("node")))
    labels = spark.createDataFrame([(1, 1), (5, 1)], "node long, component long")
    pairs = h.crossing_pairs(members, labels, sketches, sets.select("node", "set"), settings)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2            # the members of pairs are found on registers; their sets follow
    found = {(r.a, r.b, r.sure) for r in pairs.collect()}
    # of the links from 2 to the component of 1 and 5, one or more in different cells; 3 and 4 link with nothing
    assert found and found <= {(1, 2, True), (2, 5, True)}
