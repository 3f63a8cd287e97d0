"""Sentence units across languages and scripts, by cascading tables of break and no-break rules.

A text is first cut into blocks: headings, log lines, list items and paragraphs (runs of other lines; a blank
line ends one). Inside a block every place where a unit could end is decided by ordered rules: a rule has a
pattern for what stands before the place, one for what stands after it, and says break or no break; the first
rule that matches both decides. The rules stand in tables: a common one, one for each language of the script
before the place (the text's ``lang`` only sets their order, as it may be wrong), and a last one. Places
inside a closed quotation or bracket are no candidates.

Texts are split where they are: no shuffle, linear in the text's length, whatever source holds the rows.

Defined results: null, empty, blank and wordless texts give no rows; every non-blank character of other texts
is in exactly one unit; pieces without words join the unit before them in their block (else the one after);
repeated rows give their units again; ``lang`` may be null or wrong; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: A run of signs in a wrapped line is no heading.
_HEADING = regex.compile(r"\s*#{1,6}(?:\s|$)")
_LOG = regex.compile(r"\s*\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}")
_ITEM = regex.compile(r"\s*(?:[-*•‣◦▪·–—+]|[0-9]{1,3}[.)]|\([0-9a-z]{1,3}\))\s+(?=\S)")
_WORD = regex.compile(r"[\p{L}\p{N}]")

_MARKS = r".!?…。！？｡．।॥؟۔։᙮⁇⁈⁉‼\u037e።፧។៕။᠃᠉꓿"
_CLOSERS = "\"”’»›“)）]】」』》〉}"
#: A place: marks, then closing quotes or brackets (French ones after a space), then perhaps marks again.
_PLACE = re.compile(rf"[{_MARKS}]+(?P<close>(?:[{regex.escape(_CLOSERS)}]|\s»)*)")
#: In Greek a semicolon asks.
_GREEK_PLACE = re.compile(_PLACE.pattern.replace(f"[{_MARKS}]+", f"[{_MARKS};]+"))
_THAI_LETTER = re.compile("[\u0e00-\u0e7f]")
_THAI_SPACE = regex.compile(r"(?<=[฀-๿])[^\S\r\n]+(?=[฀-๿A-Za-z])")

_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "{": "}", "«": "»", "‹": "›"}
_BRACKETY = re.compile(r"[()（）\[\]【】「」『』《》〈〉{}«»‹›“”„\"]")


class Rule(NamedTuple):
    """dot: only after a full stop; glued: only where no blank follows; caseless: only where the last letter has no case."""

    breaks: bool
    before: regex.Pattern
    after: regex.Pattern
    caseless: bool
    dot: bool
    glued: bool


def rule(breaks: bool, before: str, after: str = "", caseless: bool = False) -> Rule:
    """before is read backwards from the place, after forwards."""
    return Rule(breaks, regex.compile(f"(?r)(?:{before})"), regex.compile(after), caseless, before.endswith(r"\."), bool(after) and not after.startswith(r"\s"))


#: The beginning of a word; it may follow a sentence without a blank.
_NAMED = r"(?:(?<![\p{L}\p{N}_.])|(?<=[\p{Ll})]{2}\.))"
#: The next word is an identifier of code, whose lower case says nothing.
_CODE = r"\s*[\p{Ps}\p{Pi}\"]*[a-z][a-z0-9]*(?:_[a-z0-9]+)+"
_LOWER = r"\s*[\p{Ps}\p{Pi}\p{Pd}\"¿¡\s]*\p{Ll}"
#: Words that mostly begin a sentence where they have a capital.
_STARTS = (
    r"\s+(?:The|A|An|It|Its|He|She|They|We|You|I|This|That|These|Those|There|Here|In|On|At|By|For|From|With|But|And|Or|So|If|When|While|After|Before|As|No|Not|All|Both|Each|However|Then|Now|Who|What|Why|How|Where)\b"
)

def shortened(words: str) -> list[Rule]:
    """Rules of abbreviations that may end a sentence: they do before a word that mostly begins one."""
    return [rule(True, _NAMED + rf"(?:{words})\.", _STARTS), rule(False, _NAMED + rf"(?:{words})\.")]


# Abbreviations of each language and what they are followed by.
TABLES: dict[str, list[Rule]] = {
    "common": [
        # A mark in the middle of a number, a name or a file name is none.
        rule(False, r"[.!?…]", r"[\p{Ll}\p{N}_/\\-]"),
        # A missing blank between two sentences.
        rule(True, r"(?<![\p{L}\p{N}_.])[\p{L}\p{N}’'-]*[\p{Ll}\p{N}%)][.!?…]+[\"”»)]*", r"\p{Lu}\p{Ll}*(?:\s|[.…]{3}|[’'])|\p{Lu}\p{Ll}+[.!?](?:\s|$)"),
        rule(False, r"[.]", r"[^\s\p{Lo}]"),
    ],
    "en": [
        rule(False, _NAMED + r"(?:Dr|Mr|Mrs|Ms|Messrs|Prof|Rev|Hon|Gen|Col|Capt|Lt|Sgt|St|Mt)\."),
        rule(False, _NAMED + r"(?:e\.\s?g|i\.\s?e|cf|vs|viz|approx|esp|resp|incl|excl|ca|al)\."),
        rule(False, _NAMED + r"(?:[Nn]os?|[Ss]ecs?|[Ff]igs?|[Ee]qs?|[Cc]h|[Vv]ol|[Pp]p?|[Aa]rt|[Pp]ar|[Tt]ab|[Mm]in|[Mm]ax)\.", r"\s*[(#]?\p{N}"),
        rule(False, _NAMED + r"[ap]\.\s?m\.", r"\s+(?:UTC|GMT|BST|JST|CES?T|E[SD]T|C[SD]T|P[SD]T)\b"),
        rule(False, _NAMED + r"(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.", r"\s+\p{N}"),
        rule(False, _NAMED + r"(?:Adm|Brig|Cmdr|Cpl|Gov|Maj|Pres|Rep|Sen|Supt|Fr|Sr?gt|Ft)\.", r"\s+\p{Lu}"),
        *shortened(r"[Ii]nc|[Ll]td|[Cc]orp|[Cc]o|[Bb]ros|[Jj]r|[Ss]r|[Ee]sq|[Aa]ve|[Bb]lvd|[Rr]d|[Hh]wy|[Dd]ept|[Uu]niv|[Aa]ssn|[Ii]nst|[Gg]ovt|[Mm]gmt|[Mm]fg|[Ee]xt|[Ee]d|[Ee]ds|[Tt]rans|[Rr]ev|[Mm]isc|Ph\.\s?D|M\.\s?D|B\.\s?A|M\.\s?A"),
    ],
    "de": [
        rule(False, _NAMED + r"(?:z\.\s?B|d\.\s?h|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?R|u\.\s?U|s\.\s?o|s\.\s?u|v\.\s?a)\."),
        rule(False, _NAMED + r"(?:z|d|u|o|i|s|v)\.", r"\s*(?:B|h|a|ä|d|R|U|o|u)\."),
        rule(False, _NAMED + r"(?:bzw|vgl|Vgl|ca|Nr|Abs|Art|Bd|Kap|Abb|Hr|Fr|Dr|Prof|Mio|Mrd|Tsd|evtl|ggf|inkl|exkl|bspw|sog|gem|lt|max|mind|Str|St)\."),
        # Ordinal numbers: the eighteenth of April, the nineteenth attempt.
        rule(False, r"\b(?:[AaIiVvZz][mn]|[Vv]om|[Zz]u[mr]|[Bb]eim|[Bb]is|[Dd](?:er|ie|as|en|em|es)|[Ss]eit|[Aa]b|[Nn]ach|[Vv]or)\s+\p{N}{1,3}\.", r"\s+\p{L}"),
        rule(False, r"(?<![\p{N}.,:])\p{N}{1,2}\.", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b"),
    ],
    "fr": [
        rule(False, _NAMED + r"(?:p\.\s?ex|c\.-à-d|MM?|Mlle|Mme|Dr|Pr|cf|env|art|chap|fig|vol|éd|hab|réf|tél|av|bd)\."),
        rule(False, _NAMED + r"(?:p|pp|n|no|nos)\.", r"\s*(?:\p{N}|ex\.)"),
    ],
    "es": [
        rule(False, _NAMED + r"(?:p\.\s?ej|Sra?s?|Srta|Dra?s?|D|Dña|Ud|Uds|Vd|Lic|Ing|Prof|aprox|núm|núms|pág|págs|art|cap|fig|vol|tel|av|avda)\."),
        rule(False, _NAMED + r"(?:p|pp|n)\.", r"\s*(?:\p{N}|ej\.)"),
        rule(False, _NAMED + r"EE\.", r"\s*UU\."),
    ],
    "ru": [
        rule(False, _NAMED + r"(?:т|и)\.", r"\s*(?:е|д|п|к|н|о)\."),
        rule(False, _NAMED + r"(?:т\.\s?(?:е|к|н|о)|см|ср|стр|гл|рис|табл|напр|прим|тыс|млн|млрд|трлн|руб|долл|им|ул|пл|проф|акад|г-н|г-жа|св|пп?|ст|обл|тов)\."),
        rule(True, _NAMED + r"т\.\s?[дп]\.", r"\s+\p{Lu}"),
        rule(False, r"(?<![\p{L}\p{N}_.])\p{Lu}\.", r"\s*\p{Lu}"),
    ],
    "ar": [rule(False, _NAMED + r"(?:ص|د|أ|م|ج|ط|هـ|ق|ت|ر|س)\.", r"\s*\S")],
    "hi": [rule(False, r"(?<![\p{L}\p{M}\p{N}])(?:डॉ|पृ|प्रो|श्री|सं|ई|उदा|क्र|रु|कं|लि)\.", r"\s*\S")],
    "th": [
        rule(False, r"(?<![฀-๿])(?:น|พ\.ศ|ค\.ศ|ดร|นาย|เม\.ย|ม\.ค|ก\.พ|มี\.ค|พ\.ค|มิ\.ย|ก\.ค|ส\.ค|ก\.ย|ต\.ค|พ\.ย|ธ\.ค|จ|อ|ต|กม|ซม|บ|รศ|ผศ|ศ)\.", r"\s*\S"),
        # The sign of repetition belongs to the word before it and leads on.
        rule(False, r"[ๆฯ]\s*", r""),
        rule(False, r"\s*", r"[ๆฯ]"),
        # A word of another script continues the sentence, unless it opens a sentence of its own.
        rule(True, r"[฀-๿]\s+", r"[A-Z][a-z]+['’]?[a-z]*\s+[a-z]"),
        rule(False, r"\s+", r"[A-Za-z]"),
        rule(True, r"[฀-๿]\s+", r"[฀-๿]"),
    ],
    "ko": [rule(False, _NAMED + r"(?:No|vs|Dr|Mr|Ms)\.", r"\s*\S")],
    "zh": [],
    "ja": [],
    "it": [
        rule(False, _NAMED + r"(?:[Ss]ig|[Ss]igg|[Ss]ig\.ra|[Ss]ig\.na|[Dd]ott|[Dd]ott\.ssa|[Dd]r|[Pp]rof|[Aa]vv|[Ii]ng|[Aa]rch|[Gg]eom|[Rr]ag|[Oo]n|[Ss]en|[Cc]av|[Ss]pett|[Ee]gr|[Gg]ent)\."),
        rule(False, _NAMED + r"(?:ad es|p\.\s?es|cfr|es|ca|cd|fig|tab|cap|vol|art|artt|n|nn|p|pp|pag|pagg|tel|sec|min|max|[Pp]\.zza|v|vd)\."),
        rule(False, r"\b(?:a|d)\.", r"\s*[Cc]\."),
    ],
    "pt": [
        rule(False, _NAMED + r"(?:[Ss]ra?s?|[Ss]rta|[Dd]ra?s?|[Pp]rofa?|[Ee]ng|[Ee]ngª|[Ee]xmo|[Ee]xma|D|Av|R|Pç|Trav)\."),
        rule(False, _NAMED + r"(?:p\.\s?ex|aprox|núm|pág|págs|art|cap|fig|vol|tel|min|máx|obs|séc|ed|cf|[Nn])\."),
    ],
    "nl": [
        rule(False, _NAMED + r"(?:[Dd]r|[Dd]rs|[Ii]r|[Ii]ng|[Mm]r|[Pp]rof|[Dd]hr|[Mm]evr|[Mm]w|[Ss]t)\."),
        rule(False, _NAMED + r"(?:bijv|bv|d\.w\.z|o\.a|m\.a\.w|t\.o\.v|i\.v\.m|ca|nl|nr|blz|fig|art|incl|excl|evt|resp|max|min|jl|zgn)\."),
    ],
    "pl": [
        rule(False, _NAMED + r"(?:np|tj|tzn|tzw|m\.in|ok|ul|al|pl|nr|str|rys|tab|prof|dr|mgr|inż|gen|ks|św|im|godz|min|tys|mln|mld|zł|gr|wg|zob|por|red|wyd|art|ust|pkt)\."),
    ],
    "tr": [rule(False, _NAMED + r"(?:[Dd]r|[Pp]rof|[Dd]oç|[Aa]v|[Ss]n|vb|vs|örn|bkz|yy|s|sf|No|Cad|Sok|Mah|Apt|Tel)\."), rule(False, r"(?<![\p{N}.,:])\p{N}{1,3}\.", r"\s+\p{Ll}")],
    "cs": [rule(False, _NAMED + r"(?:např|tj|tzn|tzv|apod|atd|atp|č|čl|str|obr|tab|kap|viz|p|pí|sl|[Dd]r|[Ii]ng|[Mm]gr|[Bb]c|[Pp]rof|[Dd]oc|[Mm]UDr|JUDr|tis|mil|mld|ul|nám)\.", r"\s*\S")],
    "sv": [rule(False, _NAMED + r"(?:t\.ex|bl\.a|m\.m|d\.v\.s|dvs|osv|s\.k|ca|kl|nr|st|[Dd]r|[Pp]rof|jfr|fig|kap|sid|tel|max|min)\.", r"\s*\S")],
    "el": [rule(False, _NAMED + r"(?:π\.χ|δηλ|κ|κα|κος|κ\.λπ|κ\.ά|βλ|σελ|αρ|παρ|κεφ|τηλ|ευρ|εκ|δισ|καθ|[Δδ]ρ|μ\.μ|π\.μ)\.", r"\s*\S"), rule(True, r"\p{Greek}\s*;", r"\s+\p{Lu}")],
    "uk": [rule(True, _NAMED + r"т\.\s?[дп]\.", r"\s+\p{Lu}"), rule(False, _NAMED + r"(?:т\.\s?(?:д|п|ч|е|зв)|напр|див|рис|табл|стор|ст|вул|просп|пл|м|обл|р|рр|тис|млн|млрд|грн|коп|ім|проф|акад|доц)\.")],
    "bg": [rule(False, _NAMED + r"(?:т\.\s?е|напр|вж|стр|фиг|табл|ул|бул|гр|обл|хил|млн|млрд|лв|проф|доц|инж)\.")],
    "fa": [rule(False, _NAMED + r"(?:ص|ق|م|ه|ش|د|دکتر|ر\.ک)\.", r"\s*\S")],
    "ur": [rule(False, _NAMED + r"(?:ص|ڈاکٹر|م|ع)\.", r"\s*\S")],
    "he": [rule(False, r"(?<![\p{Hebrew}])(?:ד״ר|ד\"ר|פרופ['׳]?|עמ['׳]?|מס['׳]?|וכו['׳]?|ר['׳]?)\.?", r"\s*\S")],
    "bn": [rule(False, r"(?<![\p{L}\p{M}])(?:ড|ডা|মি|মো|মোঃ|পৃ|প্রফে|নং)\.", r"\s*\S")],
    "mr": [rule(False, r"(?<![\p{L}\p{M}])(?:डॉ|श्री|पृ|क्र|रु|उदा)\.", r"\s*\S")],
    "ta": [rule(False, r"(?<![\p{L}\p{M}])(?:திரு|டாக்டர்|பக்|எண்)\.", r"\s*\S")],
    "initials": [
        # Initials of names; the last letter of an abbreviation such as U.S. is none.
        rule(False, r"(?<![\p{L}\p{N}_.'’])\p{Lu}\.", r"\s+\p{Lu}"),
    ],
    "quoted": [
        # After a closing quote or bracket: in scripts without case only a further mark ends a unit, else a capital.
        rule(False, r"", r"\s*[,;:，、；：،؛)）\]」』]"),
        rule(False, r"", r"\s*[\p{Ps}\p{Pi}\p{Pd}\"\s]*[\p{Lo}\p{Lm}]"),
        rule(True, r"", _CODE),
        rule(False, r"", _LOWER),
        rule(False, r"", r"", caseless=True),
        rule(False, r"", r"[^\s]"),
        rule(True, r"", r""),
    ],
    "last": [
        rule(True, r"", r"\s+\p{Lu}"),
        rule(False, r"", r"\s*[,;:，、；：،؛]"),
        # Full-width marks and those of scripts without blanks end a unit wherever they stand.
        rule(True, rf"[。！？｡．।॥؟۔።፧។៕။᠃᠉꓿][{_MARKS}{regex.escape(_CLOSERS)}\s]*", r""),
        rule(True, r"[!?…]+", r"[\p{Lo}]"),
        rule(True, r"(?:[\p{Han}\p{Hiragana}\p{Katakana}%\p{N}])…+", r"[^\s.]"),
        rule(True, r"", r"\s+" + _CODE),
        rule(False, r"", _LOWER),
        rule(True, r"", r"\s"),
        rule(False, r"", r""),
    ],
}
_OF_SCRIPT = {
    "latin": ("en", "de", "fr", "es"), "cyrillic": ("ru",), "greek": ("el",), "arabic": ("ar",), "hebrew": ("he",), "devanagari": ("hi",), "bengali": ("bn",), "tamil": ("ta",),
    "thai": ("th",), "hangul": ("ko",), "han": ("zh", "ja"), "other": (),
}
#: Languages whose table counts only where the text is said to be in them: they share a script with others.
_IF_SAID = {"latin": ("it", "pt", "nl", "pl", "tr", "cs", "sv"), "cyrillic": ("uk", "bg"), "arabic": ("fa", "ur"), "devanagari": ("mr",)}
_SCRIPT = regex.compile(
    r"(?P<latin>\p{Latin})|(?P<cyrillic>\p{Cyrillic})|(?P<greek>\p{Greek})|(?P<arabic>\p{Arabic})|(?P<hebrew>\p{Hebrew})|(?P<devanagari>\p{Devanagari})|(?P<bengali>\p{Bengali})|(?P<tamil>\p{Tamil})"
    r"|(?P<thai>\p{Thai})|(?P<hangul>\p{Hangul})|(?P<han>[\p{Han}\p{Hiragana}\p{Katakana}])|(?P<other>.)",
    regex.S,
)
_LAST_LETTER = regex.compile(r"(?r)\p{L}")
_CASELESS = regex.compile(r"[\p{Lo}\p{Lm}]")


@lru_cache(65536)
def _letter(letter: str) -> tuple[str, bool]:
    return _SCRIPT.match(letter).lastgroup, bool(_CASELESS.match(letter))


class _Letters:
    """The script of the last letter before a place, and whether it has no case; places must be asked for in order."""

    def __init__(self, text: str, start: int):
        self.text, self.upto, self.script, self.caseless = text, start, "latin", False

    def before(self, at: int) -> tuple[str, bool]:
        if at > self.upto:
            # Most marks follow a letter.
            letter = self.text[at - 2] if at - 2 >= self.upto and self.text[at - 2].isalpha() and not self.text[at - 1].isalpha() else None
            if letter is None and (m := _LAST_LETTER.search(self.text, self.upto, at)):
                letter = m.group()
            if letter:
                self.script, self.caseless = _letter(letter)
            self.upto = at
        return self.script, self.caseless


#: Rules that are tried in order, and a pattern that what stands before the place must meet for any of them (or none).
Group = tuple[regex.Pattern | None, tuple[Rule, ...]]


@lru_cache(4096)
def cascade(script: str, lang: str, quoted: bool, dot: bool, blank: bool) -> tuple[Group, ...]:
    """The rules that decide a place, in order: of the common table, of the languages of the script, of the last table.

    Rules that cannot match after (or before) such a sign are left out; those of the languages have one pattern in
    front of them, as most words are no abbreviations.
    """
    languages = [*(x for x in _IF_SAID.get(script, ()) if x == lang), *sorted(_OF_SCRIPT[script], key=lambda x: x != lang)]
    names = [["common"], languages, ["initials", "last"]]
    if quoted:
        names = [["common", "quoted"]] if script != "thai" else [["common", "th", "quoted"]]
    groups: list[Group] = []
    for part in names:
        rules = tuple(r for name in part for r in TABLES[name] if (dot or not r.dot) and not (blank and r.glued))
        if rules:
            either = regex.compile("(?r)" + "|".join(r.before.pattern.removeprefix("(?r)") for r in rules)) if part is languages else None
            groups.append((either, rules))
    return tuple(groups)


def protected_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost closed quotations and brackets of a block, as [open, after close)."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []

    def close(mark: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if mark in stack[k][0]:
                opened = stack[k][1]
                del stack[k:]
                while spans and spans[-1][0] > opened:
                    spans.pop()
                spans.append((opened, at + 1))
                return True
        return False

    for m in _BRACKETY.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            before = text[i - 1] if i > start else " "
            after = text[i + 1] if i + 1 < end else " "
            opens = (before.isspace() or before in "(（[「『《«，、：；。！？,:" or i == start) and not after.isspace()
            if not (not opens and close('"', i)) and not after.isspace():
                if any('"' in s[0] for s in stack):
                    close('"', i)
                else:
                    stack.append(('"', i))
        elif c == "“":
            if not any("“" in s[0] for s in stack) or not close("“", i):
                stack.append(("”", i))
        elif c == "„":
            stack.append(("“”", i))
        elif c in _PAIRS:
            # Reversed guillemets: a « may close a ».
            if not (c in "«‹" and any(c in s[0] for s in stack) and close(c, i)):
                stack.append((_PAIRS[c], i))
        elif not close(c, i) and c in "»›":
            stack.append(({"»": "«", "›": "‹"}[c], i))
    spans.sort()
    return spans


_THAI: tuple[Group, ...] = ((None, tuple(TABLES["th"])),)


def _decide(text: str, start: int, at: int, end: int, groups: tuple[Group, ...], caseless: bool) -> bool:
    """Whether a unit ends at a place: the first matching rule of the cascade."""
    for either, rules in groups:
        if either is None or either.match(text, start, at):
            for r in rules:
                if (caseless or not r.caseless) and r.after.match(text, at, end) and r.before.match(text, start, at):
                    return r.breaks
    return False


def _places(text: str, start: int, end: int, lang: str, has_thai: bool) -> list[int]:
    """Where units of a block end, in order; not the block's own end."""
    spans = protected_spans(text, start, end)
    letters = _Letters(text, start)
    ends: list[int] = []
    k = 0

    def inside(at: int) -> bool:
        nonlocal k
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        return k < len(spans) and spans[k][0] < at < spans[k][1]

    found = [(m.end(), bool(m["close"])) for m in (_GREEK_PLACE if lang == "el" else _PLACE).finditer(text, start, end)]
    thai = [(m.end(), None) for m in _THAI_SPACE.finditer(text, start, end)] if has_thai else None
    if thai:
        found = sorted(found + thai, key=lambda x: x[0])
    for at, quoted in found:
        if at >= end or inside(at):
            continue
        if quoted is None:
            if _decide(text, start, at, end, _THAI, False):
                ends.append(at)
        else:
            script, caseless = letters.before(at)
            if _decide(text, start, at, end, cascade(script, lang, quoted, text[at - 1] == ".", text[at].isspace()), caseless):
                ends.append(at)
    return ends


def blocks(text: str) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, first place, end) of every block: heading, log, item or paragraph."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    opened = None
    for a, b in lines:
        line = text[a:b]
        blank = not line.strip()
        if blank:
            kind = None
        elif _HEADING.match(line):
            kind = "heading"
        elif _LOG.match(line):
            kind = "log"
        elif item := _ITEM.match(line):
            kind = "item"
        else:
            kind = "paragraph"
        if opened is not None and kind != "paragraph":
            yield "paragraph", opened[0], opened[0], opened[1]
            opened = None
        if kind == "paragraph":
            opened = (opened[0] if opened else a, b)
        elif kind == "item":
            yield kind, a, a + item.end(), b
        elif kind:
            yield kind, a, a, b
    if opened is not None:
        yield "paragraph", opened[0], opened[0], opened[1]


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """[start, end) of every sentence unit of a text, in code points."""
    if not text or not _WORD.search(text):
        return []
    short, has_thai = (lang or "").lower()[:2], bool(_THAI_LETTER.search(text))
    out: list[tuple[int, int]] = []
    for kind, start, first, end in blocks(text):
        cuts = _places(text, first, end, short, has_thai) if kind in ("item", "paragraph") else []
        mine: list[list[int]] = []
        for a, b in zip([start, *cuts], [*cuts, end]):
            piece = text[a:b]
            body = piece.strip()
            if not body:
                continue
            a += len(piece) - len(piece.lstrip())
            if mine and not _WORD.search(body):
                mine[-1][1] = a + len(body)
            elif mine and not _WORD.search(text[mine[-1][0] : mine[-1][1]]):
                mine[-1][1] = a + len(body)
            else:
                mine.append([a, a + len(body)])
        out += [(a, b) for a, b in mine]
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of every sentence unit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in units(text, lang):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], schema=_OUT)

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, start_char long, end_char long")
