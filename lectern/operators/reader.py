"""What a reader sees of the cards of a run under the chosen switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import strip


def with_state(cards: DataFrame, state: DataFrame, key: str = "paper_id") -> DataFrame:
    """Cards with the flags of their paper; papers without feedback are unread and unmarked."""
    flags = ("read", "favorite", "irrelevant")
    joined = cards.join(state.select(key, *[F.col(f).alias(f"_{f}") for f in flags]), key, "left")
    return joined.select(*cards.columns, *[F.coalesce(f"_{f}", F.lit(False)).alias(f) for f in flags])


def visible(
    search_text: Column, query: str = "", show_irrelevant: bool = False, unread_only: bool = False, favorites_only: bool = False
) -> Column:
    """Whether a card of :func:`with_state` is shown; all switches must agree.

    The trimmed query must occur in ``search_text`` without regard to case; a blank one finds all.
    """
    shown = [F.lit(True)]
    if not show_irrelevant:
        shown.append(~F.col("irrelevant"))
    if unread_only:
        shown.append(~F.col("read"))
    if favorites_only:
        shown.append(F.col("favorite"))
    if query.strip():
        shown.append(F.contains(F.lower(search_text), F.lower(strip(F.lit(query)))))
    verdict = shown[0]
    for more in shown[1:]:
        verdict = verdict & more
    return F.coalesce(verdict, F.lit(False))
