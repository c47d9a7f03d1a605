"""The nested models as formulas: picks, votes and utilities."""

from __future__ import annotations

#: What describes a comment (the first eight for root comments, where the rest is constant), its
#: article, its tree; and the dummies of a policy.
COMMENT = "sentiment_prob_pos sentiment_prob_neg lexdiv_cttr num_punct num_sentences SMOG_readability second_person user_follower is_root_comment level_in_tree".split()
ROOT_COMMENT = COMMENT[:8]
ARTICLE = "cosine_1 hours_since_article votes_pos_mean votes_neg_mean article_comments".split()
TREE = "is_leaf_comment size_of_tree height_of_tree all_replies".split()
POLICIES = "policy_neg-abs policy_least-neg-abs policy_pos-abs policy_pos-rel policy_rev-chron policy_chron policy_pin-pred-lr policy_pin-pred-xgb policy_pred-nb policy_pred-xgb".split()
REPLIES = ["replies_rh", "replies_rt"]


def _formula(response: str, *parts: list[str]) -> str:
    return f"{response} ~ {' + '.join(x for part in parts for x in part)}"


def pick_models(genres: list[str]) -> dict[str, str]:
    """Three logits of picks among root comments; genres: the dummies without the base's."""
    base = [ROOT_COMMENT, ARTICLE, genres]
    return {"pins_1": _formula("pinned", *base), "pins_2": _formula("pinned", *base, TREE), "pins_3": _formula("pinned", *base, TREE, ["votes_neg_log", "votes_pos_log"])}


def vote_models(genres: list[str], response: str = "votes_pos") -> dict[str, str]:
    """Four negative binomial models of up- or down-votes; the last has the other votes too."""
    base, other = [COMMENT, ARTICLE, genres], "votes_neg_log" if response == "votes_pos" else "votes_pos_log"
    models = [[*base], [*base, ["pinned"]], [*base, TREE, ["pinned"]], [*base, TREE, ["pinned", other]]]
    return {f"{response}_{k}": _formula(response, *m) for k, m in enumerate(models, 1)}


def utility_models(response: str = "utility", policies: list[str] = POLICIES) -> dict[str, str]:
    """Six beta regressions of utilities, from no interaction to all."""
    p, r = f"({' + '.join(policies)})", " + ".join(REPLIES)
    right = [f"{p} + {r} + pinned", f"{p} * ({r}) + pinned", f"{p} * pinned + {r}", f"{p} * ({r} + pinned)", f"{p} * ({r} + pinned) + ({r}):pinned", f"{p} * ({r}) * pinned"]
    return {f"utility_{k}": f"{response} ~ {x}" for k, x in enumerate(right, 1)}
