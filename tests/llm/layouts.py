"""Pages made by hand, not by the generator that the network learns from, with their main text."""

MENU = "<a href=/>Start</a> <a href=/shop>Shop</a> <a href=/map>Map</a>"
ONE = "The river rose during the night and by morning the lower road was under water."
TWO = "Two families were taken to the school, where volunteers had set up beds and a kitchen."
THREE = "The mayor said that the dam upstream had held, though the gates would stay open all week."
FOUR = "Meteorologists expect drier weather from Thursday on."

PAGES = {
    "tables": (f"""<html><body><table width=100%><tr><td colspan=2>{MENU}</td></tr><tr><td><h1>Flood in the valley</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></td>
<td><b>Latest</b><br><a href=/1>Team wins again</a><br><a href=/2>New bridge</a></td></tr><tr><td colspan=2>© 2019 Valley Courier</td></tr></table>""",
               ["Flood in the valley", ONE, TWO, THREE]),
    "cells": (f"""<body><center><table><tr><td><a href=a>Home</a></td><td><a href=b>Archive</a></td></tr></table><table><tr><td>{ONE} {TWO}</td></tr><tr><td>{THREE}</td></tr></table>
<table><tr><td>All rights reserved</td></tr></table></center>""", [f"{ONE} {TWO}", THREE]),
    "code": ("<article><pre>def add(a, b):\n    return a + b</pre><ul><li>Adds two numbers</li><li>Returns the sum</li></ul></article><aside>Buy the book</aside>",
             ["def add(a, b): return a + b", "Adds two numbers", "Returns the sum"]),
    "definitions": (f"<nav>{MENU}</nav><main><h1>Words of the river</h1><dl><dt>Weir</dt><dd>{ONE}</dd><dt>Sluice</dt><dd>{TWO}</dd></dl></main><footer>© Glossary</footer>",
                    ["Words of the river", "Weir", ONE, "Sluice", TWO]),
    "names outside the lists": (f"<div id=kopf>{MENU}</div><div class=hauptspalte><h2>Hochwasser</h2><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div>"
                                f"<div class=randspalte><ul><li><a href=1>Mehr</a></li><li><a href=2>Wetter</a></li></ul></div><div class=fuss>© Bote</div>",
                                ["Hochwasser", ONE, TWO, THREE]),
    "bare": (f"<html><head><title>T</title></head><body><h1>Flood</h1><p>{ONE}<p>{TWO}<p>{THREE}<p>{FOUR}</body></html>", ["Flood", ONE, TWO, THREE, FOUR]),
    "comments as articles": (f"<article><h1>Flood</h1><p>{ONE}</p><p>{TWO}</p></article><section class=comments><article class=comment><p>Stay safe everyone, we are thinking of you.</p></article></section>",
                             ["Flood", ONE, TWO]),
    "teasers": (f"<main><article><h1>Flood</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></article></main><div class=related><article><a href=x><h3>Team wins</h3></a></article>"
                f"<article><a href=y><h3>New bridge</h3></a></article></div>", ["Flood", ONE, TWO, THREE]),
    "blog": (f"<div id=page><div id=masthead><a href=/>Valley blog</a></div><div class='post hentry'><h2 class=entry-title>Flood</h2><div class=entry-content><p>{ONE}</p><blockquote>{THREE}</blockquote>"
             f"<p>{TWO}</p></div></div><div id=secondary class=widget-area><h3>Archives</h3><ul><li><a href=m>March</a></li></ul></div></div>", ["Flood", ONE, THREE, TWO]),
}


def block_scores(found: dict[str, list[str]]) -> tuple[float, float]:
    """Precision and recall of main-text blocks over all pages."""
    right = sum(len(set(found[k]) & set(w)) for k, (_, w) in PAGES.items())
    return right / max(1, sum(map(len, found.values()))), right / sum(len(w) for _, w in PAGES.values())
