"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.ann import op6_nearest
from tessera.llm.collocations import OP12_SQL, op12_collocations
from tessera.llm.decontaminate import op5_decontaminate
from tessera.llm.erratatrie import OP11_SQL, op11_variants
from tessera.llm.innertopk import OP13_SQL, op13_products
from tessera.llm.langid import op2_langid
from tessera.llm.orderminhash import op9_near_duplicates
from tessera.llm.packing import op7_pack
from tessera.llm.paragraphs import op4_paragraphs
from tessera.llm.quality import op8_quality
from tessera.llm.sitetree import op1_extract
from tessera.llm.suffixlevels import op10_repeats
from tessera.llm.surrogates import op3_surrogates


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_extract": op1_extract,
        "op2_langid": op2_langid,
        "op3_surrogates": op3_surrogates,
        "op4_paragraphs": op4_paragraphs,
        "op5_decontaminate": op5_decontaminate,
        "op6_nearest": op6_nearest,
        "op7_pack": op7_pack,
        "op8_quality": op8_quality,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_repeats": op10_repeats,
        "op11_variants": op11_variants,
        "op12_collocations": op12_collocations,
        "op13_products": op13_products,
    }


def oracle_sql() -> dict[str, str]:
    found = {"pipeline": corpus_pipeline.ORACLE_SQL, "op11_variants": OP11_SQL, "op12_collocations": OP12_SQL, "op13_products": OP13_SQL}
    return {name: sql for name, sql in found.items() if sql}
