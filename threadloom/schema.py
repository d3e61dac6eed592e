"""Row types and run parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields

COMMENT = "pos bigint, comment_id string, user_id string, username string, text string, timestamp bigint, likes bigint, raw string"
#: A snapshot file: an object with comments, whose raw part may be any JSON.
SNAPSHOT_COMMENT = "struct<comment_id:string,user_id:string,username:string,text:string,timestamp:bigint,likes:bigint,raw:string>"
SNAPSHOT = f"video_url string, saved_at string, count bigint, comments array<{SNAPSHOT_COMMENT}>"
EDGE = "source string, target string, weight double"

# The keys that may name a parent, in order.
PARENT_KEYS = ("reply_comment_id", "reply_to_comment_id", "parent_comment_id", "reply_id", "reply_comment", "parent_id")
TEXT_KEYS = ("text", "comment", "content", "desc", "description", "reply_text", "reply_comment", "comment_text", "title")
PROFILE_KEYS = ("nickname", "signature", "bio", "bio_description")
LABEL_KEYS = ("account_labels", "user_tags", "type_label")

_RANGES = {"max_comments": (10, 10_000), "k_neighbors": (1, 200), "canopy_t1": (0, 1), "canopy_t2": (0, 1)}


@dataclass(frozen=True)
class Params:
    """Parameters of a run; a value outside its range is a ValueError that names the field."""

    max_comments: int | None = 200  # None: all
    alpha_mention: float = 1.0
    beta_reply: float = 0.8
    gamma_content: float = 0.5
    delta_thread: float = 0.5
    k_neighbors: int = 15
    canopy_t1: float = 0.6
    canopy_t2: float = 0.8
    auto_tune_canopy: bool = True
    use_ann: bool = True  # accepted; pairs are always found exactly
    use_mst_overlay: bool = True  # accepted and without effect
    cross_canopy_penalty: float = 0.6

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or value is None and f.name == "max_comments":
                continue
            low, high = _RANGES.get(f.name, (0, float("inf")))
            if not low <= value <= high:
                raise ValueError(f"{f.name}: {value} is not between {low} and {high}")
