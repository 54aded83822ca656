"""Queries of names, numbers, addresses and places over documents and rough candidates."""

from __future__ import annotations

from docsift.functions import entities as en
from docsift.plans.rough import register

register("en2_phone", ["phone"], lambda d: [*en.lines_layer(d), *en.phone_first(d)])
register("en4_name", ["name"], lambda d: [*en.lines_layer(d), *en.name_first(d)])
register("en5_location", ["location"], lambda d: [*en.lines_layer(d), *en.place_first(d)])
register("en6_entities", ["name", "email", "phone", "location", "confidence"], en.entities_a)
register("en6_entities_detailed", ["name", "email", "phone", "location", "confidence", "text_length", "line_count"], en.entities_detailed)
register("en7_entities", ["name", "email", "phone", "location", "linkedin", "github", "portfolio"], en.entities_b)


def _contexts(d):
    before, after = en.window_at("raw", "40", 25)
    return [*en.lines_layer(d), *en.contexts(d, "raw", "(?:web|the|project|der|les|con)", 20), {"found": d.join("contexts", "~"), "before_40": before, "after_40": after}]


register("en14_contexts", ["found", "before_40", "after_40"], _contexts)
