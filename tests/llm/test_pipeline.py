"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

import corpus_pipeline as p
from chunkwell.llm import common, decontaminate, near_dedup, registry

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.read(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "temperature_mixing", "sharding"]
    kept = common.cut(p.quality_stage(spark, docs, SF))
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    labels = common.read(spark, SF, "labels")
    wrong = kept.join(labels.where("quality = 0"), "doc_id", "left_semi").count() + labels.where("quality = 1").join(docs, "doc_id", "left_semi").join(kept, "doc_id", "left_anti").count()
    assert wrong <= 0.05 * labels.count()
    single = common.cut(p.near_dedup_stage(spark, kept, SF))
    assert single.columns == columns and near_dedup.classes(single).where("not kept").count() == 0
    clean = common.cut(p.decontaminate_stage(spark, single, SF))
    assert clean.columns == columns and decontaminate.decontaminate(clean, common.read(spark, SF, "benchmark")).where("contaminated").count() == 0
    mixed = common.cut(p.mixing_stage(spark, clean, SF))
    assert mixed.columns == columns and 0 < mixed.count()
    sharded = p.sharding_stage(spark, mixed, SF)
    assert sharded.count() == mixed.count()


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
