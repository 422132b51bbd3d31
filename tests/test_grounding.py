from dossier.operators import evaluation


def test_states_findings_and_summary_of_a_run(spark):
    cases = spark.createDataFrame(
        [(1, "published", True, 1), (2, "published", False, 1), (3, "rejected", True, 2), (4, "not_found", False, 1), (5, "execution_error", False, 0), (6, "published", True, 1)],
        "case_id int, outcome string, expected_publishable boolean, calls int",
    )
    required = spark.createDataFrame([(1, "C1", "abc"), (1, "C2", "abc"), (1, "C2", "abc"), (3, "C1", "x"), (5, "C1", "x"), (6, "C1", "x"), (6, "C1", None)], "case_id int, citation_id string, text string")
    cited = spark.createDataFrame([(1, "C1", "no"), (1, "C1", "xabcx"), (1, "C2", "ab"), (3, "C1", "x"), (6, "C1", None), (6, "C1", "x")], "case_id int, id string, quote string")
    checks = evaluation.passage_checks(required, cited, cases)
    got = sorted((r.case_id, r.citation_id, r.state) for r in checks.collect())
    assert got == [(1, "C1", "present"), (1, "C2", "missing"), (1, "C2", "missing"), (3, "C1", "not_observed"), (5, "C1", "not_observed"), (6, "C1", "missing"), (6, "C1", "present")]
    assert dict(evaluation.passage_states(cases, checks).collect()) == {1: "missing", 2: "not_applicable", 3: "not_observed", 4: "not_applicable", 5: "not_observed", 6: "missing"}
    found = evaluation.case_findings(cases, checks)
    lost = "relevant_passage_missing"
    assert sorted((r.case_id, r.kind) for r in found.collect()) == [(1, lost), (1, lost), (2, "non_publishable_published"), (3, "publishable_rejected"), (5, "execution_error"), (6, lost)]
    row = evaluation.grounding_summary(cases, found).first().asDict()
    assert row == {"total_cases": 6, "cases_with_findings": 5, "total_findings": 6, "calls": 6, "published": 3, "typed_refusals": 1, "not_found": 1, "execution_error": 1, "non_publishable_published": 1, "publishable_rejected": 1, lost: 3, "exit_code": 2}
    clean = cases.where("case_id = 4")
    assert evaluation.grounding_summary(clean, evaluation.case_findings(clean, checks.limit(0))).first().exit_code == 0
    none = cases.limit(0)
    assert evaluation.grounding_summary(none, evaluation.case_findings(none, checks.limit(0))).first().total_cases == 0
