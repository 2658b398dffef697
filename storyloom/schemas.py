"""Explicit schemas of the engine's tables (spans are half-open code-point ranges of work.norm_text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "work": "id string, title string, author string, source string, license string, raw_text string, norm_text string, char_count int, created_at timestamp",
    "chapter": "id string, work_id string, idx int, title string, char_start int, char_end int",
    "scene": "id string, work_id string, chapter_id string, idx int, char_start int, char_end int, heading string",
    "chunk": "id string, work_id string, scene_id string, idx int, char_start int, char_end int, token_start int, token_end int, text string, sha256 string",
    "embedding_ref": "chunk_id string, collection string, model string, dim int",
    "motif": "id string, name string, summary string, long_desc string, tags array<string>, source_url string, aliases array<string>, anti_aliases array<string>, created_at timestamp, updated_at timestamp",
    "candidate": "id string, work_id string, scene_id string, chunk_id string, motif_id string, surface string, alias string, start int, end int, source string, score double, created_at timestamp",
    "finding": "id string, work_id string, scene_id string, chunk_id string, motif_id string, level string, confidence double, rationale string, evidence_start int, evidence_end int, model string, verifier_score double, verifier_flag string, calibration_version string, threshold_used double, run_id string, created_at timestamp",
    "motif_relation": "src string, dst string, rel string",
    "motif_group": "id string, name string",
    "motif_group_member": "motif_id string, group_id string",
    "support_selection": "scene_id string, chunk_id string, rank int, stage1_score double, stage2_score double, picked int",
    "motif_sanity": "scene_id string, motif_id string, lex_ok int, sem_sim double, weight double",
    "decision": "id string, finding_id string, decision string, corrected_start int, corrected_end int, corrected_motif_id string, note string, reviewer string, created_at timestamp",
    "run": "id string, created_at timestamp, params_json string",
    "motif_threshold": "motif_id string, threshold double, samples int, precision double, recall double, f1 double, method string",
    "vector": "id string, embedding array<float>, work_id string, scene_id string, chunk_id string, chunk_idx int, char_start int, char_end int, model string",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table in order: missing ones null, others cast, extra ones dropped."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(TABLES[name]).fields
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
