"""Graphs as SVG drawings: atoms as labelled discs, bonds as lines, laid out by springs."""

from __future__ import annotations

from html import escape

import numpy as np

from . import elements as el

SIZE, RADIUS = 400, 14


def layout(n: int, edges: list[tuple[int, int]], rounds: int = 200) -> np.ndarray:
    """Places in the unit square: bonded nodes attract each other, all repel; the start is a circle, so that equal graphs look alike."""
    turn = 2 * np.pi * np.arange(n) / max(1, n)
    x = np.stack([np.cos(turn), np.sin(turn)], 1) * 0.5
    a, b = (np.array([e[k] for e in edges], int) for k in (0, 1))
    best = 1 / np.sqrt(max(1, n))
    for step in range(rounds):
        d = x[:, None] - x[None]
        far = np.maximum(np.sqrt((d * d).sum(-1)), 1e-3)
        force = (d / far[..., None] * (best**2 / far)[..., None]).sum(1)
        if len(edges):
            pull = x[a] - x[b]
            pull *= np.sqrt((pull * pull).sum(1))[:, None] / best
            np.add.at(force, a, -pull)
            np.add.at(force, b, pull)
        size = np.maximum(np.sqrt((force * force).sum(1)), 1e-9)
        x += force / size[:, None] * np.minimum(size, 0.1 * (1 - step / rounds))[:, None]
    x -= x.min(0)
    return x / max(1e-9, x.max())


def svg(labels: list[str], symbols: list[str], edges: list[tuple[int, int]]) -> str:
    """A drawing of one graph."""
    number = {s: z for s, *_, z in el.rows()}
    x = layout(len(labels), edges) * (SIZE - 4 * RADIUS) + 2 * RADIUS
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{SIZE}" height="{SIZE}">']
    out += [f'<line x1="{x[i][0]:.1f}" y1="{x[i][1]:.1f}" x2="{x[j][0]:.1f}" y2="{x[j][1]:.1f}" stroke="#555555" stroke-width="2"/>' for i, j in edges]
    for (u, v), label, sym in zip(x, labels, symbols, strict=True):
        out.append(f'<circle cx="{u:.1f}" cy="{v:.1f}" r="{RADIUS}" fill="{el.colour(number.get(sym))}" stroke="#555555"/>')
        out.append(f'<text x="{u:.1f}" y="{v + 4:.1f}" font-size="11" text-anchor="middle">{escape(label)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
