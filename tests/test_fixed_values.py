"""Fixed values that the SQL counterparts take from the modules, pinned here by literals."""

from lumenmatch.functions import text
from lumenmatch.operators import banks, clusters, evidence, frames, mentions, reports, similarity


def test_thresholds_and_weights():
    assert banks.OUTLIER_BELOW == 0.68
    assert similarity.COMPETITOR_WEIGHTS == (0.5, 0.3, 0.2) and similarity.MARGIN == 0.12
    assert (similarity.TOP_REFS, similarity.TOP_CLUSTER, similarity.TOP_NEGS) == (5, 3, 3)
    assert (frames.INTERVAL_SECONDS, frames.EVEN_FRAMES, frames.MAX_KEPT, frames.BLUR_LIMIT) == (2.0, 6, 15, 40.0)
    assert (frames.SAME_HISTOGRAM, frames.SAME_STRUCTURE, frames.LOOK_BACK, frames.NEIGHBOUR_OFFSETS) == (0.98, 0.05, 3, (-5, -2, 2, 5))
    assert evidence.LAYERS == {"image": 0.0, "prompt": 0.8, "caption": 0.7, "detection": 0.7, "ocr": 0.7, "color": 0.0}
    assert (evidence.FIRED_BONUS, evidence.RELIABLE_FACTOR, evidence.RELIABLE) == (1.5, 0.85, ("image", "ocr"))
    assert reports.HISTOGRAM_EDGES == (0.0, 0.5, 0.7, 0.8, 0.9, 1.01)
    assert (text.MAX_EDITS, mentions.EVIDENCE_CHARS) == (2, 200)


def test_shapes_of_lists():
    assert list(clusters.CATEGORIES) == ["logo_refs", "drink_refs", "product_refs", "store_refs"] and [len(v) for v in clusters.CATEGORIES.values()] == [9, 14, 10, 14]
    assert (len(mentions.PROMPT_TEMPLATES), len(mentions.NEGATIVE_PROMPTS), len(mentions.CLASS_TEMPLATES), len(mentions.SCENE_WORDS)) == (6, 5, 3, 23)
    assert len(reports.PLATFORMS) == 6 and len(reports.DEBUG_HEADER) == 13
