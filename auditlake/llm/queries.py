"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from auditlake.llm import chat, collocations, decontamination, exact_dedup, language, licences, manifest, near_dedup, packing, pii, scoring, substring_dedup, suffix_dedup


def pipeline(spark, sf_dir):
    """The corpus pipeline of the repository's top folder."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_pii": pii.op2_pii,
        "op3_katz_scoring": scoring.op3_katz_scoring,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_language_id": language.op8_language_id,
        "op9_licence_scan": licences.op9_licence_scan,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_chat_format": chat.op13_chat_format,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": exact_dedup.ORACLE_OP7,
        "op9_licence_scan": licences.ORACLE_OP9,
        "op11_phrase_collocations": collocations.ORACLE_OP11,
        "op12_merkle_manifest": manifest.ORACLE_OP12,
        "op13_chat_format": chat.ORACLE_OP13,
    }
