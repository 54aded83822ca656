"""Queries of headers, sections, blocks and section classes over documents and rough candidates."""

from __future__ import annotations

from docsift.functions import classify as cf
from docsift.functions import entities as en
from docsift.functions import headers as hd
from docsift.functions.dialect import DuckDB
from docsift.plans.rough import register
from docsift.plans.sectioned import BLOCKS, MERGED, SECTIONS


def _start(d):
    return en.lines_layer(d)


def _plains(d):
    """Arrays of their own, as what stands in a lambda is computed anew wherever it is named."""
    return [{"lines": d.each("doc_lines", "x", d.strip("x"))}, {"plains": d.each("lines", "x", hd.plain(d, "x"))}]


register(
    "se1_se2_header_aliases", ["found"],
    lambda d: [*_start(d), *_plains(d), {"named": d.each("plains", "x", f"x || '=' || {hd.lookup(d, 'x', hd.ALIASES)}")}, {"found": d.join_lines(d.where("named", "x", "x IS NOT NULL"))}],
)
register("se3_headers", ["found"], lambda d: [*_start(d), *_plains(d), {"keys": d.each(d.count_to(d.size("lines")), "i", hd.header(d, d.at("lines", "i"), d.at("plains", "i")))}, {"found": d.join(d.where("keys", "x", "x IS NOT NULL"), "|")}])
register("se4_merged_headers", ["merged_text"], lambda d: [{"merged_text": d.join_lines("merged")}], first=MERGED)
register("se5_sections", ["sections"], lambda d: [{"sections": hd.shown(d, "section")}], first=SECTIONS)
register("se8_block_sections", ["blocks"], lambda d: [{"blocks": hd.shown(d, "block")}], first=BLOCKS)
register("se13_se14_canonical_sections", ["sections"], lambda d: [*hd.canonical(d), {"sections": hd.shown(d, "canon")}], first=SECTIONS)


def _classes(rules):
    def layers(d):
        names = d.concat("run_titles", d.take("full_lines", 2), d.array("''", "'Skills & more'", "'Volunteering'", "'Co-Curricular:'"))
        top = d.take("full_lines", 8)
        lines = {"full_lines": d.where(d.each("doc_lines", "x", d.strip("x")), "x", "x <> ''")}
        if not isinstance(d, DuckDB):
            # what isn't a run's own name stands over the top lines or over nothing: each content is read once, for all its names
            named = lambda cond: f"transform(filter(sequence(1, size(every_name)), k -> {cond}), k -> named_struct('item', k, 'name', get(every_name, k - 1)))"
            of_content, of_name = cf.classified_once(d, rules)
            return [
                lines,
                {"every_name": names, "top_lines": top},
                {"run_items": "transform(run_names, (s, k) -> array(named_struct('item', k + 1, 'name', get(every_name, k))))", "top_items": named("k > size(run_names) AND k % 3 <> 0"), "no_items": named("k > size(run_names) AND k % 3 = 0")},
                {"contents": f"concat(transform(run_items, (s, k) -> named_struct('content', get(run_lines, k), 'items', s)), array(named_struct('content', top_lines, 'items', top_items), named_struct('content', {d.empty()}, 'items', no_items)))"},
                {"one": "explode_outer(contents)"},  # not explode: there the optimizer asks for a size first, and makes the lines anew for it
                {"content": "one.content", "items": "one.items"},
                *of_content,
                {"of_item": "explode_outer(items)"},
                {"item": "of_item.item", "name": "of_item.name"},
                *of_name,
                {"is_confident": cf.is_confident()},
            ]
        return [
            lines,
            {"every_name": names},
            {"every_content": d.each(d.count_to(d.size("every_name")), "k", f"CASE WHEN k <= {d.size('run_names')} THEN {d.at('run_lines', 'k')} WHEN k % 3 = 0 THEN {d.empty()} ELSE {top} END")},
            {"item": d.explode(d.count_to(d.size("every_name")))},
            {"name": d.at("every_name", "item"), "content": d.at("every_content", "item")},
            *cf.classified(d, rules),
            {"is_confident": cf.is_confident()},
        ]

    return layers


register("se10_classifier_a", ["item", "name", "category", "confidence", "method", "content_length"], _classes(cf.A), first=SECTIONS, scanned=("content_text",))
register("se11_classifier_b", ["item", "name", "category", "confidence", "method"], _classes(cf.B), first=SECTIONS, scanned=("content_text",))
register("se12_confident_classes", ["item", "category", "is_confident"], _classes(cf.A), first=SECTIONS, scanned=("content_text",))
