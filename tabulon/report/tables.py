"""Result tables of stored models as text, Markdown, LaTeX or tab-separated values, and simple SVG charts of aggregated data."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame

from tabulon.models.linear import Estimates


def number(x: float, digits: int = 7) -> str:
    """The most significant digits that fit, without a leading zero."""
    if x is None or x != x:
        return "."
    s = f"{x:.{digits}g}"
    return s.replace("0.", ".", 1) if s.startswith("0.") else s.replace("-0.", "-.", 1) if s.startswith("-0.") else s


def stars(p: float, levels: tuple[float, ...] = (0.1, 0.05, 0.01)) -> str:
    return "*" * sum(p < a for a in levels) if p == p else ""


def grid(models: dict[str, Estimates], under: str = "se", digits: int = 3, star: bool = True, stats: tuple[str, ...] = ("N", "r2"), keep: list[str] | None = None, drop: list[str] | None = None, labels: dict[str, str] | None = None) -> list[list[str]]:
    """Rows of cells: a header, two rows per term (coefficient, and se, t or p in brackets), one per statistic."""
    terms = [t for t in dict.fromkeys(n for m in models.values() for n in m.names) if (not keep or t in keep) and t not in (drop or [])]
    terms.sort(key=lambda t: t == "_cons")
    rows = [["", *models]]
    found = {k: {r["term"]: r for r in m.table()} for k, m in models.items()}
    for t in terms:
        one, two = [(labels or {}).get(t, t)], [""]
        for k in models:
            r = found[k].get(t)
            one.append("" if r is None else f"{r['b']:.{digits}f}" + (stars(r["p"]) if star else ""))
            two.append("" if r is None else f"({r[under]:.{digits}f})")
        rows += [one, two]
    for s in stats:
        rows.append([s, *["" if (v := m.stats.get(s)) is None else f"{v:.0f}" if s in ("N", "N_g", "df_m") else number(float(v), 4) for m in models.values()]])
    return rows


TEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def render(rows: list[list[str]], form: str = "plain", title: str = "", notes: list[str] = ()) -> str:
    """plain, markdown, latex or tsv."""
    if form == "tsv":
        return "\n".join(["\t".join(r) for r in rows] + list(notes)) + "\n"
    if form == "markdown":
        body = ["| " + " | ".join(c.replace("|", r"\|").replace("*", r"\*") for c in r) + " |" for r in rows]
        body.insert(1, "|" + "---|" * len(rows[0]))
        return "\n".join(([f"**{title}**", ""] if title else []) + body + list(notes)) + "\n"
    if form == "latex":
        tex = lambda s: "".join(TEX.get(c, c) for c in s)
        lines = [" & ".join(map(tex, r)) + r" \\" for r in rows]
        head = [r"\begin{table}", r"\centering", *([rf"\caption{{{tex(title)}}}"] if title else []), r"\begin{tabular}{l" + "c" * (len(rows[0]) - 1) + "}", r"\hline"]
        return "\n".join([*head, lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", *map(tex, notes), r"\end{table}"]) + "\n"
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    line = lambda r: "  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True)))
    rule = "-" * (sum(width) + 2 * (len(width) - 1))
    return "\n".join([*([title] if title else []), rule, line(rows[0]), rule, *map(line, rows[1:]), rule, *notes]) + "\n"


class Ledger:
    """Stored models: store, restore, table; and the columns that one outreg-like file gathers."""

    def __init__(self):
        self.models: dict[str, Estimates] = {}
        self.files: dict[str, dict[str, Estimates]] = {}

    def store(self, name: str, e: Estimates) -> None:
        self.models[name] = e

    def restore(self, name: str) -> Estimates:
        return self.models[name]

    def table(self, *names: str, form: str = "plain", **options) -> str:
        return render(grid({n: self.models[n] for n in names or self.models}, **options), form)

    def outreg(self, path: str, e: Estimates, title: str, replace: bool = False, **options) -> str:
        """Adds a column to the file's table and writes it anew, tab-separated."""
        held = {} if replace else self.files.get(path, {})
        held[title] = e
        self.files[path] = held
        text = render(grid(held, **options), "tsv")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return text


# --- charts ------------------------------------------------------------------------

W_, H_, PAD = 640, 420, 48
#: Points beyond which a chart asks for aggregation first.
MAX_POINTS = 50_000
#: Boxes that a chart can show.
MAX_BOXES = 200


def _scale(lo: float, hi: float, a: float, b: float):
    span = (hi - lo) or 1.0
    return lambda v: a + (v - lo) / span * (b - a)


def _frame(body: str, title: str) -> str:
    axes = f'<path d="M{PAD} {PAD}V{H_ - PAD}H{W_ - PAD}" fill="none" stroke="#444"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{W_}" height="{H_}" font-family="sans-serif" font-size="12"><text x="{W_ / 2}" y="24" text-anchor="middle">{escape(title)}</text>{axes}{body}</svg>'


def _points(df: DataFrame, x: str, y: str) -> list[tuple[float, float]]:
    rows = df.select(x, y).dropna().limit(MAX_POINTS + 1).collect()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points; aggregate or bin first")
    return [(float(a), float(b)) for a, b in rows]


def chart(df: DataFrame, x: str, y: str, kind: str = "scatter", title: str = "") -> str:
    """scatter, line (sorted by x) or connected, of an aggregated frame."""
    pts = _points(df, x, y)
    if kind != "scatter":
        pts.sort()
    if not pts:
        return _frame("", title)
    sx = _scale(min(p[0] for p in pts), max(p[0] for p in pts), PAD + 8, W_ - PAD - 8)
    sy = _scale(min(p[1] for p in pts), max(p[1] for p in pts), H_ - PAD - 8, PAD + 8)
    body = ""
    if kind in ("line", "connected"):
        body += '<polyline fill="none" stroke="#1f5fa8" points="' + " ".join(f"{sx(a):.1f},{sy(b):.1f}" for a, b in pts) + '"/>'
    if kind in ("scatter", "connected"):
        body += "".join(f'<circle cx="{sx(a):.1f}" cy="{sy(b):.1f}" r="2.5" fill="#1f5fa8"/>' for a, b in pts)
    return _frame(body, title)


def histogram(bins: DataFrame, title: str = "") -> str:
    """Bars of ``histogram_bins``."""
    rows = bins.orderBy("bin").collect()
    if not rows:
        return _frame("", title)
    lo, hi = rows[0]["lower"], rows[-1]["lower"] + rows[-1]["width"]
    sx, sy = _scale(lo, hi, PAD, W_ - PAD), _scale(0, max(r["freq"] for r in rows), H_ - PAD, PAD + 8)
    bars = "".join(f'<rect x="{sx(r["lower"]):.1f}" y="{sy(r["freq"]):.1f}" width="{sx(r["lower"] + r["width"]) - sx(r["lower"]):.1f}" height="{H_ - PAD - sy(r["freq"]):.1f}" fill="#8fb3d9" stroke="#fff"/>' for r in rows)
    return _frame(bars, title)


def boxes(stats: DataFrame, over: str, title: str = "") -> str:
    """Boxes and whiskers of ``box_stats``."""
    rows = stats.orderBy(over).limit(MAX_BOXES + 1).collect()
    if len(rows) > MAX_BOXES:
        raise ValueError(f"more than {MAX_BOXES} boxes do not fit a chart; keep fewer groups")
    if not rows:
        return _frame("", title)
    sy = _scale(min(r["lower_adjacent"] for r in rows), max(r["upper_adjacent"] for r in rows), H_ - PAD - 8, PAD + 8)
    step = (W_ - 2 * PAD) / len(rows)
    body = ""
    for i, r in enumerate(rows):
        x, w = PAD + step * (i + 0.2), step * 0.6
        m = x + w / 2
        body += f'<path d="M{m:.1f} {sy(r["lower_adjacent"]):.1f}V{sy(r["upper_adjacent"]):.1f}" stroke="#444"/><rect x="{x:.1f}" y="{sy(r["q3"]):.1f}" width="{w:.1f}" height="{sy(r["q1"]) - sy(r["q3"]):.1f}" fill="#8fb3d9" stroke="#444"/><path d="M{x:.1f} {sy(r["median"]):.1f}h{w:.1f}" stroke="#000"/><text x="{m:.1f}" y="{H_ - PAD + 16}" text-anchor="middle">{escape(str(r[over]))}</text>'
    return _frame(body, title)


def combine(charts: list[str], columns: int = 2) -> str:
    rows = math.ceil(len(charts) / columns)
    inner = "".join(f'<g transform="translate({i % columns * W_},{i // columns * H_})">{c}</g>' for i, c in enumerate(charts))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{columns * W_}" height="{rows * H_}">{inner}</svg>'
