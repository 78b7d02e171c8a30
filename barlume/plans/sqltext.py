"""Helpers that spell out oracle SQL."""

from __future__ import annotations

OVER = "PARTITION BY instrument ORDER BY ts"


def roll(agg: str, x: str, n: int, least: int | None = None, over: str = OVER) -> str:
    f = f"OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {n if least is None else least} THEN {agg}({x}) {f} END"


def rank_share(x: str, n: int, least: int) -> str:
    f = f"OVER ({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count({x}) {f} >= {least} THEN "
        f"len(list_filter(list({x}) {f}, lambda e: e <= {x})) / (count(*) {f}) END"
    )


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({OVER})"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def ewm(src: str, specs: dict[str, tuple[str, float, int]]) -> str:
    """Brute-force recurrence: every row as an explicit weighted sum of its past."""
    first = ", ".join(
        f"min(CASE WHEN {x} IS NOT NULL THEN rn END) OVER (PARTITION BY instrument) AS f_{n}" for n, (x, _, _) in specs.items()
    )
    sums = ", ".join(
        f"CASE WHEN count(j.{x}) >= {least} THEN sum(CASE WHEN j.rn = j.f_{n} THEN 1.0 ELSE {a!r} END "
        f"* pow(1.0 - {a!r}, t.rn - j.rn) * j.{x}) END AS {n}"
        for n, (x, a, least) in specs.items()
    )
    return f"""SELECT b.*, e.* EXCLUDE (instrument, ts) FROM {src} b JOIN (
      WITH n AS (SELECT *, row_number() OVER ({OVER}) AS rn FROM {src}), m AS (SELECT *, {first} FROM n)
      SELECT t.instrument, t.ts, {sums} FROM m t JOIN m j ON j.instrument = t.instrument AND j.rn <= t.rn
      GROUP BY t.instrument, t.ts) e ON e.instrument = b.instrument AND e.ts = b.ts"""


def wilder(src: str, n: int = 14, prefix: str = "wl") -> dict[str, str]:
    """CTEs ending in ``{prefix}``: src plus atr, rsi, adx."""
    a = 1.0 / n
    return {
        f"{prefix}_in": f"""SELECT *, {TR} AS tr, greatest(close - {lag('close')}, 0) * (CASE WHEN {lag('close')} IS NOT NULL THEN 1 END) AS g,
          greatest({lag('close')} - close, 0) * (CASE WHEN {lag('close')} IS NOT NULL THEN 1 END) AS ls,
          CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0 END AS pdm,
          CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0 END AS mdm
          FROM {src}""",
        f"{prefix}_s1": ewm(f"{prefix}_in", {"atr": ("tr", a, n), "ag": ("g", a, n), "al": ("ls", a, n), "ap": ("pdm", a, n), "am": ("mdm", a, n)}),
        f"{prefix}_s2": f"""SELECT *, 100 - 100 / (1 + ag / (al + 1e-9)) AS rsi,
          100 * abs(100 * ap / (atr + 1e-9) - 100 * am / (atr + 1e-9)) / (100 * ap / (atr + 1e-9) + 100 * am / (atr + 1e-9) + 1e-9) AS dx
          FROM {prefix}_s1""",
        prefix: ewm(f"{prefix}_s2", {"adx": ("dx", a, n)}),
    }
