"""Queries of text cleaning: every step on its own over the texts as they come, the chain, and rules over lines."""

from __future__ import annotations

from docsift.functions import cleaning as cl
from docsift.plans.rough import register

_NAMES = {
    "tx1a": "newlines_hyphens", "tx1b": "artifacts", "tx1c": "bullets", "tx1d": "ascii_fold", "tx1e": "spaced_headers", "tx1f": "addresses",
    "tx1g": "split_headers", "tx1h": "letter_spacing", "tx1i": "camel_case", "tx1j": "lone_headers", "tx1k": "blanks_watermarks",
}
for _id, _name in _NAMES.items():
    # steps that the chain runs on folded text see it folded here too
    _before = (cl.newlines, cl.fold_ascii) if _id in ("tx1e", "tx1f", "tx1g", "tx1h", "tx1i", "tx1j", "tx1k") else ()
    register(f"{_id}_{_name}", ["clean"], lambda d, steps=_before + cl.STEPS[_id]: cl.layers(d, steps))
register("tx1_clean_text", ["clean"], lambda d: cl.layers(d, cl.CHAIN))
register("tx2_alternate_clean", ["clean"], lambda d: cl.alternate(d, "text"))
register("tx3_noise", ["clean"], lambda d: [{"clean": cl.without_noise(d, "coalesce(text, '')")}])
register("tx7_spacing", ["spaced"], lambda d: cl.normal_spacing(d, "text"))
register("tx9_clean_line", ["clean"], lambda d: [{"clean": d.join_lines(d.each(d.split_lines("coalesce(text, '')"), "x", cl.clean_line(d, "x")))}])


def _lines(d):
    number = lambda rule: d.size(d.where("all_lines", "x", rule(d, "x")))
    return [
        {"all_lines": cl.stripped_lines(d, "coalesce(text, '')")},
        {"lines": d.join_lines("all_lines"), "n_lines": d.size("all_lines"), "n_bullets": number(cl.is_bullet), "n_headings": number(cl.is_heading)},
    ]


register("tx4_lines", ["lines", "n_lines"], _lines)
register("tx5_bullet_lines", ["n_bullets"], _lines)
register("tx6_heading_lines", ["n_headings"], _lines)
