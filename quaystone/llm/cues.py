"""Sentence ends by plain cues, for operators that need a rough split of a line (problems 4 and 5)."""

from __future__ import annotations

import re

from quaystone.llm.sentences import _THAI_GAP, _TERM, _TOKEN, _WIDE, _quotes

#: Abbreviations that a name, a number or a noun follows.
BOUND = frozenset(
    "dr prof mr mrs ms mme mlle sr sra srta m mm hr fr doç z b u a d h p ej cf vs approx incl e.g i.e para abs abschn nr núm vol pp bzw ca ggf mio mrd tsd yakl md bkz αρ κ κα σελ د م أ डॉ श्री".split()
)
#: Abbreviations that a number follows; before a capital letter they are words.
COUNTED = frozenset("no num art sec ch st av tab fig jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic".split())
#: Abbreviations that may also be the last word.
EITHER = frozenset("inc ltd co corp plc llc u.k u.s e.u p.m a.m a.ş etc al usw κ.λπ κ.ά s.a s.l bros jr".split())
#: German and Turkish months, which follow an ordinal with a full stop.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split())


def _next_kind(par: str, at: int) -> tuple[str, str]:
    """(kind, word) of what follows a position, past blanks and opening quotes."""
    m = re.compile(r"[\s\"“„«‘「『(\[¿¡  ]*").match(par, at)
    i = m.end()
    if i >= len(par):
        return "end", ""
    c = par[i]
    if c.isdigit():
        return "digit", ""
    if c.isalpha():
        word = re.compile(r"[^\W\d_]+").match(par, i).group().lower()
        return ("lower" if c.islower() else "upper" if c.isupper() or c.istitle() else "caseless"), word
    return ("comma" if c in ",;:،、，؛：-–—)" else "other"), ""


def ends(par: str) -> list[int]:
    """Positions after which a sentence of the paragraph ends, but for the last."""
    spans, out, last = _quotes(par), [], -1
    closes = {b for _, b in spans}
    opened = {b: a for a, b in spans}
    start = 0  # of the current sentence, by the cues
    k_span = 0
    for m in _TERM.finditer(par):
        mark, e = m.group()[-1], m.end()
        quote = None
        while e < len(par):
            c = par[e]
            if e in closes:
                quote = e
                e += 1
            elif c in ")]}’" and c not in "\"“":
                e += 1
            elif c in "   " and e + 1 in closes and par[e + 1] in "»›":
                quote = e + 1
                e += 2
            else:
                break
        if e < m.end() or last >= e:
            continue
        spaced = e >= len(par) or par[e].isspace()
        wide = mark in _WIDE
        if not spaced and not wide and mark in ".…":
            continue
        kind, word = _next_kind(par, e)
        if not spaced and not wide and kind != "end" and par[e : e + 1] not in "“„«「『¿¡":
            if kind != "comma":
                continue
        prev = _TOKEN.search(par, max(0, m.start() - 24), m.start())
        token = prev.group().lower().strip("'’") if prev else ""
        tail = token.rsplit("’", 1)[-1]
        while k_span < len(spans) and spans[k_span][1] < m.start():
            k_span += 1
        inside = any(a < m.start() and b >= e for a, b in spans[max(0, k_span - 2) : k_span + 6])
        shape = (
            "bound" if mark == "." and (tail in BOUND or (len(tail) == 1 and tail.isalpha() and mark == "."))
            else "either" if mark == "." and (tail in EITHER or tail in COUNTED or "." in tail)
            else "ordinal" if mark == "." and re.fullmatch(r"\d{1,2}", tail) and (kind == "lower" or word in MONTHS)
            else "plain"
        )
        framing = "none"
        if quote is not None:
            before = par[start : opened[quote]].rstrip()
            framing = "colon" if before[-1:] in ":：" and before else "first" if not before else "mid"
        particle = par[e : e + 1] in "とはがをにのも、，" if wide else False
        caseless = kind == "caseless"
        label: int | None
        if kind == "end":
            label = 1
        elif kind == "comma" or inside or particle or kind == "lower":
            label = 0
        elif shape == "bound" or shape == "ordinal":
            label = 0
        elif shape == "either":
            label = 1 if kind == "upper" else 0
        elif quote is not None and caseless and framing == "first":
            label = 0
        elif kind in ("upper", "digit", "caseless"):
            label = 1
        else:
            label = None
        last = e
        if label:
            out.append(e)
            start = e
            while start < len(par) and par[start].isspace():
                start += 1
    for m in _THAI_GAP.finditer(par):
        out.append(m.start())
    return sorted(out)
