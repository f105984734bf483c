"""Reading a listing's title: what kind of question it asks, about whom, when, and with which threshold."""

from __future__ import annotations

import html
import re
import unicodedata
from datetime import date, datetime, timedelta

# Month words, and the words of title patterns that name no subject.
MONTHS = "january february march april may june july august september october november december".split()
PATTERN_WORDS = frozenset(
    """a above agree agreement an and annual at bank be below between box bp bps by c central close closes cpi cup cut decision degrees direction drop
    election exceed exceeds finish for force gross hike high higher highest hour in increase index inflation it its jobless least less
    low lower max maximum mayoral meeting million more most no of office on opening or over pact parliamentary percent presidential price race raise
    rate rates reach reading senate settle sign signed temp temperature than that the to trade treaty truce under unemployment up usd utc
    vote vs weekend who will win winner wins with ceasefire deal down before d m k governor gubernatorial congressional""".split()
)
GOODS = ("natural gas", "crude", "copper", "cotton", "cocoa", "lumber", "silver", "wheat", "gold", "coffee", "sugar", "corn", "soybeans", "platinum", "oil", "nickel", "aluminum", "zinc", "cattle", "rice")
OFFICES = ("presidential", "senate", "mayoral", "parliamentary", "gubernatorial", "congressional")

_MONTH = {m[:k]: i for i, m in enumerate(MONTHS, 1) for k in range(3, len(m) + 1)} | {"sept": 9}
_MON = "(" + "|".join(sorted(_MONTH, key=len, reverse=True)) + ")"
_DATES = [
    (re.compile(r"\b(20\d\d)-(\d\d?)-(\d\d?)\b"), "ymd"),
    (re.compile(r"\b(\d\d?)/(\d\d?)/(\d\d(?:\d\d)?)\b"), "mdy"),
    (re.compile(rf"\b(\d\d?)[- ]{_MON}\.?[- ,]+(20\d\d|\d\d)(?![\d,.])"), "dMy"),
    (re.compile(rf"\b{_MON}\.? (\d\d?)(?:st|nd|rd|th)?,? (20\d\d)\b"), "Mdy"),
    (re.compile(rf"\b{_MON}[- ]+(20\d\d)\b"), "My"),
    (re.compile(rf"\b{_MON}-(\d\d)\b"), "My"),
    (re.compile(r"\b(20\d\d)-(\d\d)\b(?!-)"), "ym"),
    (re.compile(rf"\b{_MON}\.? (\d\d?)(?:st|nd|rd|th)?\b(?![.,]?\d|%)"), "Md"),
    (re.compile(rf"\b(\d\d?)(?:st|nd|rd|th)? {_MON}\b"), "dM"),
]
_HOUR = re.compile(r"\bhour (\d\d?)\b|\b(\d\d?):00\b|\b(\d\d)00 utc\b")
_YEAR = re.compile(r"\b(20\d\d)\b")
_NUMBER = re.compile(r"(?<![\w.])(-?\d[\d,]*(?:\.\d+)?)(?: ?(k|m|bn|million|thousand)\b(?!\w))?")
_WORD = re.compile(r"[a-z]+")
_ABOVE = re.compile(r"\b(above|over|exceeds?|higher|more|at least)\b|>=|\dm?\+|\breach\b")
_BELOW = re.compile(r"\b(below|under|lower|at most|less)\b|<=")


def fold(text: str) -> str:
    """Lower case without accents, typographic signs made plain, blanks single."""
    t = unicodedata.normalize("NFKD", html.unescape(text).lower())
    t = "".join(c for c in t if not unicodedata.combining(c))
    for a, b in (("–", "-"), ("—", "-"), ("−", "-"), ("“", ""), ("”", ""), ('"', ""), ("’", "'"), ("°", " degrees "), ("º", " degrees "), ("ß", "ss"), ("ø", "o"), ("ł", "l"), (" ", " ")):
        t = t.replace(a, b)
    return " ".join(t.split())


def skeleton(name: str) -> str:
    """The name's consonants, runs of one reduced: what abbreviations keep, and what most misspellings leave."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiou]", "", name))


def _date(t: str) -> tuple[str, tuple[int | None, int | None, int | None]]:
    for rx, form in _DATES:
        m = rx.search(t)
        if not m:
            continue
        y = mo = d = None
        for g, c in zip(m.groups(), form):
            if c == "y":
                y = int(g) + (2000 if len(g) == 2 else 0)
            elif c == "m":
                mo = int(g)
            elif c == "M":
                mo = _MONTH[g]
            else:
                d = int(g)
        if not 1 <= (mo or 1) <= 12 or not 1 <= (d or 1) <= 31:
            continue
        return t[: m.start()] + " , " + t[m.end() :], (y, mo, d)
    return t, (None, None, None)


def _place_in_time(day: tuple, close: datetime | None, created: datetime | None) -> tuple[int | None, int | None, int | None]:
    """Year of a date without one: that which brings it nearest to the close, else the next one after creation."""
    y, mo, d = day
    if y is None and mo is not None and d is not None:
        base = close or (created + timedelta(days=150) if created else None)
        if base:
            options = []
            for year in (base.year - 1, base.year, base.year + 1):
                try:
                    options.append((abs(datetime(year, mo, d) - base), year))
                except ValueError:
                    pass
            y = min(options)[1] if options else None
    return y, mo, d


def parse(title: str | None, close: datetime | None = None, created: datetime | None = None) -> dict | None:
    """kind, names (folded, most telling first), threshold, direction, detail, and the date read from the title, or None
    where nothing can be read."""
    if not title or not title.strip():
        return None
    t = fold(title).rstrip("? ")
    t, day = _date(t)
    hour = None
    m = _HOUR.search(t)
    if m and re.search(r"up or down|direction", t):
        hour = int(next(g for g in m.groups() if g))
        t = t[: m.start()] + " " + t[m.end() :]
    kind, detail, year = _kind(t), "", day[0]
    if kind == "election":
        m = _YEAR.search(t)
        if m:
            year, t = int(m.group(1)), t[: m.start()] + " " + t[m.end() :]
        detail = next(o for o in OFFICES if o in t)
    if kind == "goods":
        detail = next(g for g in GOODS if g in t)
        t = t.replace(detail, " , ")
    if kind == "index":
        t = re.sub(r"([a-z]) ?40\b", r"\1 ", t, count=1)
    if kind == "rates":
        detail = "cut" if re.search(r"\bcuts?\b|lower|decrease", t) else "hike"
    threshold = None
    if kind not in ("intraday", "election", "ceasefire", "trade", "game"):
        m = max(_NUMBER.finditer(t), key=lambda m: (bool(re.search(r"\$ ?$", t[: m.start()])), m.start()), default=None)
        if m:
            scale = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9}.get(m.group(2) or "", 1)
            scale = 1 if kind == "film" else scale
            threshold = round(float(m.group(1).replace(",", "")) * scale, 6)
    direction = ""
    if kind in ("goods", "index", "price"):
        direction = "below" if _BELOW.search(t) else "above" if _ABOVE.search(t) else ""
    names = _names(kind, t)
    if not names:
        return None
    y, mo, d = (year, None, None) if kind == "election" else _place_in_time(day, close, created)
    return {"kind": kind, "names": names, "threshold": threshold, "direction": direction, "detail": detail, "hour": hour, "year": y, "month": mo, "day": d}


def _kind(t: str) -> str:
    if re.search(r"up or down|\bdirection\b", t):
        return "intraday"
    if re.search(r"temperature|high temp|\bit reach\b", t):
        return "weather"
    if re.search(r"opening weekend|box office", t):
        return "film"
    if re.search(r"central bank|\bbank of\b|rate decision", t):
        return "rates"
    if re.search(r"inflation|\bcpi\b", t):
        return "inflation"
    if re.search(r"jobless|unemployment", t):
        return "jobless"
    if any(o in t for o in OFFICES) and re.search(r"election|\brace\b|\bvote\b", t):
        return "election"
    if re.search(r"ceasefire|truce", t):
        return "ceasefire"
    if re.search(r"\btrade (pact|treaty|deal|agreement|accord)\b", t):
        return "trade"
    if re.search(r"\bvs\b|\bwinner\b", t):
        return "game"
    if any(re.search(rf"\b{g}\b", t) for g in GOODS):
        return "goods"
    if re.search(r"[a-z] ?40 (index|close|on)\b|[a-z] ?40 ?[,:]", t):
        return "index"
    return "price"


def _names(kind: str, t: str) -> list[str]:
    if kind == "game":
        t = re.sub(r"^[^:]*: ", "", t)
        sides = re.split(r"\bvs\b\.?|\bat\b", t, maxsplit=1)
        first = [next((w for w in _WORD.findall(s) if w not in PATTERN_WORDS), None) for s in sides]
        return sorted(first) if len(first) == 2 and None not in first else []
    words = [w for w in _WORD.findall(t) if w not in PATTERN_WORDS]
    if kind in ("ceasefire", "trade"):
        return sorted(words[:2]) if len(words) >= 2 else []
    if kind == "election":
        m = re.search(r"([a-z]+) +(?:" + "|".join(OFFICES) + ")", t)
        place = m.group(1) if m else None
        rest = [w for w in words if w != place]
        if place is None or not rest:
            return []
        return [rest[-1], place, *rest[:-1][-1:]]
    if kind in ("price", "intraday"):
        return words[:2] if kind == "intraday" else words[:1]
    return words[:1]
