from test_dedup import brute_cut
from tidegauge.llm import suffixes


def test_cuts_stay_right_when_scans_are_split_anew(spark, documents, corpus):
    cut = suffixes.cut_documents(documents, 50, 10)
    # Matches are partly found by now; the last job deals the same files out in other partitions.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = cut.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.row.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) for r in found}
    assert got == dict(zip(range(len(corpus)), brute_cut([(t or "").encode() for _, t in corpus], 50)))


def test_frames_that_are_no_table_are_stored_first(spark, documents):
    twice = documents.where("doc_id < 5").selectExpr("*", "explode(array(1, 2)) AS copy")
    assert suffixes.numbered(twice).select("doc").distinct().count() == 10
