"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import chat, debruijn, decontaminate, licenses, lines, media, mixing, neardup, quality, resample, search, substring, vectors


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_substring": substring.op2_substring,
        "op3_mixing": mixing.op3_mixing,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_licenses": licenses.op5_licenses,
        "op5_whole": licenses.op5_whole,
        "op6_neardup": neardup.op6_neardup,
        "op7_debruijn": debruijn.op7_debruijn,
        "op8_chat": chat.op8_chat,
        "op9_media": media.op9_media,
        "op10_lines": lines.op10_lines,
        "op10_runs": lines.op10_runs,
        "op11_vectors": vectors.op11_vectors,
        "op12_search": search.op12_search,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring": substring.SQL,
        "op3_mixing": mixing.SQL,
        "op4_decontaminate": decontaminate.SQL,
        "op5_licenses": licenses.SQL,
        "op7_debruijn": debruijn.SQL,
        "op8_chat": chat.SQL,
        "op10_lines": lines.SQL,
        "op10_runs": lines.RUNS_SQL,
        "op11_vectors": vectors.SQL,
        "op12_search": search.SQL,
        "op13_resample": resample.SQL,
    }
