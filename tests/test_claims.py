from whence import registry

SF = "/root/testdata/sf0.001"


def test_every_generator_is_fused(spark):
    rows = registry.queries()["fuse_claims"](spark, SF).collect()
    names = {g for r in rows for g in r.generators.split(",")}
    assert names == {"temporal_proximity", "shared_identifier", "shared_entity", "historical_frequency", "statistical_association", "structural_path", "rule_based"}
    assert {r.kind for r in rows} == {"DIRECT", "CONDITIONAL", "STRUCTURAL", "STATISTICAL"}
    assert all((r.reason == "CONSTRAINT_SUPPRESSED") == (r.source_type == "error" and r.target_type != "error") for r in rows)
    pairs = {(r.source, r.target) for r in rows if r.reason is None}
    assert any((b, a) in pairs for a, b in pairs)  # times that leave the order open
    assert {r.verdict for r in rows} == {"CERTAIN", "UNDETERMINED"}
