"""What answers say: one table of templates, filled by expressions.

A slot in braces takes an expression; one with a capital letter takes it with its first letter raised.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: subject.case -> sentence.
TEMPLATES = {
    "extent.area": "{share} ({area})",
    "mix.whole": "Largest cover: {top}, {share}. In order of share: {list}.",
    "mix.none": "The image gave no class to describe.",
    "mix.first": "Land cover by share: {list}.",
    "pair.more": "{First} is the larger of the two: {list}.",
    "pair.equal": "{First} and {second} have equal shares: {list}.",
    "presence.yes": "{Class} occurs, on {extent}.",
    "presence.no": "{Class} does not occur in the class map.",
    "quantity.yes": "The share of {class} is {extent}.",
    "quantity.no": "The share of {class} is 0%.",
    "count.yes": "The share of {class} is {extent}; to have its areas counted, ask to be shown them.",
    "count.no": "The number of {class} areas is 0.",
    "location.yes": "The share of {class} is {extent}; for its places, ask to be shown them.",
    "location.no": "There is nowhere to point to: the class map has no {class}.",
    "caption.whole": "{Top} takes {share} of this view{others}{area}.",
    "caption.others": ", beside {list}",
    "caption.area": ", over {area} in all",
    "caption.none": "A view in which no class was found.",
    "change.none": "Within what noise allows, both dates look the same.",
    "change.apart": "The two dates have no valid ground in common, so nothing was compared.",
    "change.extent": "Changed: {tenth} of the ground that is valid at both dates, {about}. Both detectors saw {both} of it.",
    "change.about": "{area}, {pixels} pixels",
    "change.pixels": "{pixels} pixels",
    "change.whole": "{tenth} of the ground that is valid at both dates differs{area}. {named} Seen by both detectors: {both}.",
    "change.named": "Its largest conversion: {conversion}.",
    "change.unnamed": "Its classes are too unsure to name a conversion.",
    "change.conversion": "{before} into {after}, {share} of all change",
    "change.still": "{Class}: as much at the later date as at the earlier one",
    "change.more": "{Class}: {amount} more at the later date{relative}",
    "change.less": "{Class}: {amount} less at the later date{relative}",
    "change.relative": ", {share} of what there was",
    "change.class": "{net}; in all, {tenth} of the ground changed.{conversion}",
    "change.touching": " Largest conversion that touches it: {conversion}.",
    "ground.absent": "The class map has no {class}.",
    "ground.unmatched": "The map has {class}, yet none{where} fits the request.",
    "ground.one": "1 area of {class}{where}, {extent}.",
    "ground.many": "{n} areas of {class}{where}, {extent} together.",
    "ground.uncounted": "{Class}{where}: {extent}. How many areas that is can't be told here; radar that shows bright echoes from walls would part them.",
    "ground.where": " in the {place}",
    "ground.area": "{area} or {pixels} px",
    "ground.pixels": "{pixels} px",
    "fusion.none": "Neither sensor gave a class to any pixel.",
    "fusion.lead": "By both sensors: {top} leads with {share}; on {both} of the classified ground they say the same.",
    "fusion.decided": " Where they differ most, {part} of the scene, {arbiter} decided: {class}.",
    "fusion.open": " Where they differ most, {part} of the scene, neither was trusted over the other.",
    "scene.sure": "Scene type: {name} ({share}).",
    "scene.unsure": "Scene type unsettled; {name} is likeliest, at {share}.",
}


def _pieces(name: str) -> list[tuple[bool, str]]:
    """The template cut at its slots: whether a piece is a slot, and what it says."""
    cut = re.split(r"\{(\w+)\}", TEMPLATES[name])
    return [(k % 2 == 1, x) for k, x in enumerate(cut) if x]


def filled(name: str, /, **slots: Column) -> Column:
    """The sentence; null where a slot is."""
    raised = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    parts = [F.lit(x) if not slot else raised(slots[x.lower()]) if x[0].isupper() else slots[x] for slot, x in _pieces(name)]
    return F.concat(*parts)


def filled_sql(name: str, /, **slots: str) -> str:
    """The same in SQL."""
    raised = "(upper(left({0}, 1)) || substr({0}, 2))"
    parts = ["'" + x.replace("'", "''") + "'" if not slot else raised.format(f"({slots[x.lower()]})") if x[0].isupper() else f"({slots[x]})" for slot, x in _pieces(name)]
    return "(" + " || ".join(parts) + ")"
