"""The feature contract: names, order and families of the 79, 90, 313 and 403 columns."""

from __future__ import annotations

from brindle.functions.clouds import SPECTRAL, TDA
from brindle.functions.sequences import NLP, SYNTAX
from brindle.functions.vector import CLASSICAL

BASE = [*SYNTAX, *CLASSICAL, *SPECTRAL, *TDA]
ROUGE = [c for c in NLP if c.startswith("nlp_rouge") and c[-1] in "pr"]
RETRIEVAL = ["graph06_score", "graph06_cdf", "from_candidates", "from_graph06", "from_both"]
META = [*BASE, *ROUGE, *RETRIEVAL]

DEPTH = 4
ROLES = ("label", "synonym", "definition", "xref", "other")
TEXT_PARTS = ("exact_count", "value_jaccard", "token_jaccard", "token_dice", "token_overlap")
LABEL = ["label_exact_normalized", "label_sequence_ratio", "label_token_jaccard", "label_token_dice", "label_token_overlap", "label_token_containment", "label_prefix", "label_suffix", "label_length_difference", "label_token_count_difference", "acronym_exact", "digit_exact"]
TAGS = ["tag_count_src", "tag_count_tgt", "tag_count_difference", "tag_common_count", "tag_jaccard"]


def relation_names(depth: int = DEPTH) -> list[str]:
    return [*[f"{d}_d{k}" for d in ("ancestor", "descendant") for k in range(1, depth + 1)], "ancestors_any", "descendants_any", "siblings", "cousins", "neighbors_any"]


def deep_names(depth: int = DEPTH) -> list[str]:
    """The lexical and structural pair features, without those that look at test pairs."""
    text = lambda p: [f"{p}_{x}" for x in TEXT_PARTS]
    out = [*LABEL, *TAGS, *[f"char_ngram_{n}_jaccard" for n in range(2, 7)], *[f"word_ngram_{n}_jaccard" for n in range(1, 4)]]
    out += [*text("all_labels"), *text("all_literals")]
    for r in ROLES:
        out += text(f"role_{r}")
    for r in relation_names(depth):
        out += [f"{r}_count_src", f"{r}_count_tgt", f"{r}_count_difference", *text(r), f"train_support_{r}"]
    for a in range(1, depth + 1):
        for b in range(1, depth + 1):
            for d in ("ancestor", "descendant"):
                p = f"cross_{d}_d{a}_d{b}"
                out += [f"{p}_token_jaccard", f"{p}_exact_count", f"train_support_{p}"]
    for r in ("ancestors_any", "descendants_any", "siblings", "cousins"):
        out += [*text(f"src_concept_to_tgt_{r}"), *text(f"src_{r}_to_tgt_concept")]
    return out


DEEP = deep_names()
ALL = [*[f"meta__{c}" for c in META], *[f"deep__{c}" for c in DEEP]]

_STRUCTURAL = ("ancestor", "descendant", "sibling", "cousin", "neighbors", "cross_", "src_concept", "src_ancestor", "src_descendant", "src_sibling", "src_cousin", "train_support")


def family(column: str) -> str:
    """The expert family of a column of ALL."""
    name = column.split("__", 1)[-1]
    if column.startswith("deep__"):
        if name in LABEL or name in TAGS:
            return "syntactic"
        return "structural" if name.startswith(_STRUCTURAL) else "lexical"
    for prefix, fam in (("syn_", "syntactic"), ("cls_", "semantic"), ("spc_", "spectral"), ("tda_", "tda"), ("nlp_", "rouge")):
        if name.startswith(prefix):
            return fam
    return "retrieval"


#: Numbers of columns of each expert family.
FAMILY_SIZES = {"syntactic": 39, "lexical": 43, "semantic": 8, "rouge": 6, "retrieval": 5, "structural": 253, "spectral": 15, "tda": 34}


def spaces(columns: list[str] = ALL) -> dict[str, list[str]]:
    """Columns by family, and all of them; every column is in one family."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(family(c), []).append(c)
    if sum(map(len, out.values())) != len(columns) or len(set(columns)) != len(columns):
        raise ValueError("families don't cover the columns once")
    return out | {"global": list(columns)}
