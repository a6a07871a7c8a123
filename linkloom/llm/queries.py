"""The queries of this folder, and SQL for those that SQL can express."""

from linkloom.llm.bloom import OP3_SQL, op3_bloom_exact_dedup
from linkloom.llm.curriculum import OP9_SQL, op9_curriculum_mix
from linkloom.llm.langid import op2_kneser_ney_language
from linkloom.llm.linecrf import op1_line_crf_quality
from linkloom.llm.pieces import op4_piece_codec
from linkloom.llm.resync import op5_resync_token_counts
from linkloom.llm.shards import op7_balanced_label_shards
from linkloom.llm.simhash import op6_simhash_anchor_cover
from linkloom.llm.suffixes import op10_cover_suffix_dedup
from linkloom.llm.weaklabel import op8_weak_label_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_crf_quality,
        op2_kneser_ney_language,
        op3_bloom_exact_dedup,
        op4_piece_codec,
        op5_resync_token_counts,
        op6_simhash_anchor_cover,
        op7_balanced_label_shards,
        op8_weak_label_quality,
        op9_curriculum_mix,
        op10_cover_suffix_dedup,
    )
}
ORACLES = {"op3_bloom_exact_dedup": OP3_SQL, "op9_curriculum_mix": OP9_SQL}
