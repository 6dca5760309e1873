"""Partner names and aliases are looked up once in a text and once in a file name, whatever they turn out to be."""

from quotelake.operators.vendors import vendor_candidates


def test_one_look_up_for_names_and_aliases(spark):
    docs = spark.createDataFrame(
        [(1, "견적\n효성ITX 귀하\nAcme Display", "a.pdf", ""), (2, "견적", "견적서_acmedisplay_Youzone.pdf", "공급자")],
        "doc_id long, text string, file_name string, vendor_name string")
    found = vendor_candidates(docs, spark.createDataFrame([("Acme Display",)], "name string"))
    got = {(r.doc_id, r.value, r.source, r.confidence, r.source_order) for r in found.collect()}
    assert {(1, "효성ITX", "partner_alias", 0.98, 2), (1, "Acme Display", "partner_master_text", 0.95, 3),
            (2, "유어존", "file_name_alias", 0.92, 5), (2, "Acme Display", "file_name", 0.9, 6)} <= got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 6  # three a look-up; before, each look-up stood in the plan twice
