"""Fixed constants of the retrieval model."""

from __future__ import annotations

from dataclasses import dataclass

# Kinds that contain other symbols; all but the constructor also declare members.
CONTAINER_KINDS = ["class", "interface", "struct", "record", "enum", "type", "trait", "protocol", "namespace", "module", "object", "constructor"]
DECLARING_KINDS = [k for k in CONTAINER_KINDS if k != "constructor"]

# How strongly a reference, a provenance and a kind count; the last is the default.
REF_KIND_WEIGHT = {"define": 1.0, "write": 0.8, "read": 0.3, "pass": 0.2, None: 0.3}
PROVENANCE_WEIGHT = {"scip": 1.0, "treesitter": 0.8, "heuristic": 0.4, None: 0.4}
KIND_PRIOR = {"method": 1.0, "function": 1.0, "interface": 0.4, "protocol": 0.4, "trait": 0.4, "constructor": 0.4, None: 0.5}

#: Degree and commits at which centrality and churn reach 1, and the degree of a hub.
SATURATION = 20
GOD_NODE_DEGREE = 20

# Most evidence an anchor source can give, in the order in which sources are folded.
SOURCE_CAP = {"explicit": 1.0, "path": 0.85, "history": 0.7, "lexical": 0.8, "usage": 0.8, "semantic": 0.9, "impact": 0.7, "name": 1.0, "route": 1.0}
HOP_DECAY = 0.6
SEMANTIC_RANK_SCALE = 30
# Evidence of a text match by the part of the symbol that matched (name, its parts, container and path, text).
TIER = {"a": 1.0, "b": 0.9, "c": 0.6, "d": 0.35}
LEXICAL_POOL, LEXICAL_LIMIT, LEXICAL_LEAST, SATURATED_WEIGHT = 25, 15, 0.15, 0.35
#: What a phrase adds to the evidence of a text match.
PHRASE_WEIGHT = 1.0
# Shares of the slots that one file (of the first ones, and of those after), one owner and all containers may hold.
FILE_SHARE, FILE_TAPER, FILE_TAIL_SHARE, OWNER_SHARE, CONTAINER_SHARE = 0.6, 10, 0.1, 0.3, 0.2
STRONG_ANCHOR, WEAK_ANCHOR = 0.6, 0.35


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of the eleven terms of a candidate's score."""

    ref_kind: float = 3.0
    task_signal: float = 2.5
    centrality: float = 0.6
    proximity: float = 2.0
    leaf: float = 0.5
    provenance: float = 0.5
    anchor: float = 3.5
    test: float = 2.0
    kind: float = 2.0
    semantic_rank: float = 1.0
    churn: float = 1.0


@dataclass(frozen=True)
class Profile:
    """Constants fitted to an embedding model: its guaranteed first ranks, its share of the slots, its rank scale."""

    guard_ranks: int = 0
    reserve_share: float = 0.5
    rank_scale: int = 30
    expansion: str = "hops"


PROFILES = {"voyage": Profile(), "jina": Profile(guard_ranks=10)}
