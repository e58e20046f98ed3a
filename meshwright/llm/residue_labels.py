"""Weak labels of residue: response statuses, phrases and bracket shapes, and mentions of such things.

The lists are general vocabulary of five languages (subjects that fail, states they fail in, what
a reader is told to do); a label needs a combination of them, never a whole known line.
"""

from __future__ import annotations

import re
from http import HTTPStatus

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NAME = r"[A-Za-z\u4e00-\u9fff\u3040-\u30ff][\w.]{0,40}"
_CAPS = r"[A-Z][A-Z_ .\d]{2,40}"
#: What an author of a form is asked to do, in words that follow an opening bracket.
_ASK = r"(?:your|insert|enter|fill|add|please|type|hier|bitte|eingeben|insérer|saisir|indiquer|votre|ici)"

# ---- fixed values: bracket shapes of unfilled places --------------------------------------------
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|<%[=-]?\s*{_NAME}\s*%>|\{{%.{{1,60}}?%\}}|\[\[\s*{_NAME}\s*\]\]"
    rf"|<<\s*{_CAPS}>>|@@{_NAME}@@|%{_CAPS}%|__{_CAPS}__|«\s*{_NAME}\s*»|(?<![\\\w^_{{}}])\{{[A-Za-z]{{3,}}[\w.]*\}}"
    rf"|<[A-Za-z]+[_.][A-Za-z_.\d]+>|\b(XXX|\*\*\*) {_CAPS} \1"
    rf"|\[(?i:todo|tbd|fixme|insert)\b[^\[\]]{{0,60}}\]|\[(?i:{_ASK})\b[^\[\]]{{2,60}}\]|\[[^\[\]]{{2,60}}\b(?i:goes here|to be (?:completed|added|inserted|supplied)|einfügen|eintragen|ergänzen|ausfüllen|à (?:compléter|remplir|insérer))\]"
    r"|[【〔［\[](?:请|在此|此处|ここに)[^\[\]【】〔〕［］]{1,40}[】〕］\]]|[【〔［\[][^\[\]【】〔〕［］]{1,40}(?:を?記入|を?入力|填写|填入)[】〕］\]]",
    re.S,
)

# ---- fixed values: response statuses -------------------------------------------------------------
_REASONS = [s.phrase.lower() for s in HTTPStatus if s >= 400]
_LONG_REASONS = [r for r in _REASONS if " " in r and r not in ("not found", "not acceptable", "not implemented", "not extended", "already reported")]
_STARTS = sorted({" ".join(r.split()[:2]) for r in _REASONS})
STATUS = re.compile(
    rf"\b[45]\d\d\b[\s:\-–()]{{0,4}}(?:{'|'.join(map(re.escape, _STARTS))})|\b(?:{'|'.join(map(re.escape, _LONG_REASONS))})\b"
    r"|(?:\berror|\bfehler|\berreur|\bhttp(?:/[\d.]+)?|エラー|错误)\s*(?:code|nr\.?|no\.?)?[\s:(]*[45]\d\d\b",
    re.I,
)


def _both(subjects: str, states: str, gap: str = r"[^.。!?]{0,40}?") -> str:
    return rf"(?:{subjects}){gap}(?:{states})|(?:{states}){gap}(?:{subjects})"


# ---- fixed values: subject and state, by language -------------------------------------------------
NOTICE = re.compile(
    "|".join([
        _both(r"\b(?:page|url|site|website|server|service|document|file|resource|session|access|connection|request|full text)\b",
              r"\b(?:not found|(?:un|not )available|denied|expired|timed out|time-?out|refused|forbidden|(?:could|can)(?: ?not|n't) be (?:\w+ed|found|shown)|does(?: not|n't) exist|under maintenance|for maintenance)\b"),
        r"\b(?:something|an? (?:unexpected )?error) (?:went wrong|occurred)\b|\btry again\b|\b(?:log|sign) (?:in|on) again\b|\bpermission to (?:access|view)\b|\bcontact (?:the|your) (?:administrator|webmaster)\b",
        _both(r"\b(?:seite|website|server|dienst|sitzung|zugriff|dokument|verbindung)\b", r"\b(?:nicht (?:gefunden|verfügbar|erreichbar|berechtigt|geladen)|abgelaufen|verweigert|fehlgeschlagen|existiert nicht)\b"),
        r"\b(?:versuchen|melden|laden) sie\b[^.]{0,40}\b(?:erneut|später|neu)\b",
        _both(r"\b(?:page|site|serveur|service|session|accès|document|connexion)\b", r"introuvable|indisponible|expirée?\b|refusée?\b|interdite?\b|n'existe (?:pas|plus)|a échoué|autorisation"),
        r"\bveuillez (?:réessayer|vous (?:re)?connecter|patienter)",
        _both(r"ページ|サイト|サーバー|サービス|アクセス|セッション|ただいま", r"見つかりません|存在しません|混雑|混み合|利用できません|停止中|拒否|権限|切れ", r"[^。]{0,20}?"),
        r"再度[^。]{0,12}(?:お試し|ログイン|アクセス)",
        _both(r"页面|网页|网站|服务器|服务|会话|访问|连接", r"不存在|找不到|未找到|繁忙|不可用|拒绝|过期|超时|失败|无权", r"[^。]{0,20}?"),
        r"(?:稍后|重新)(?:再试|重试|登录|加载)",
    ]),
    re.I,
)
SCRIPT = re.compile(
    "|".join([
        _both(r"\b(?:java)?scripts?\b|\bskripte\b", r"\b(?:enabled?|activated?|(?:turn|switch)(?:ed)? (?:on|off)|(?:turned|switched|is|are) (?:on|off)|disabled|required?s?|needs?|support|blocked|allow|aktivier\w*|deaktiviert|ausgeschaltet|eingeschaltet|benötigt|erforderlich|activer|activez|activés?|l'activation|désactivés?|nécessite\w*)\b"),
        _both(r"javascript|スクリプト|脚本", r"有効|無効|必要|启用|开启|禁用|打开", r"[^。]{0,20}?"), r"<noscript",
    ]),
    re.I,
)
# ---- fixed values: filler -------------------------------------------------------------------------
LATIN = "lorem ipsum dolor dolore sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et magna aliqua enim ad minim veniam quis nostrud"
FILLER = re.compile(
    rf"(?:\b(?:{'|'.join(LATIN.split())})\b[\s,.]*){{5}}|\blorem ipsum\b"
    r"|\b(?:dummy|sample|placeholder|filler|test|example) (?:text|paragraph|content|copy|sentence)\b|\b(?:text|content|copy) goes here\b|\breplace this (?:text|paragraph)\b"
    r"|\b(?:blind|muster|platzhalter|füll|beispiel)text\w*|\bfaux[- ]texte|\btexte (?:provisoire|fictif|factice|d'exemple|de remplissage)"
    r"|(?:ダミー|サンプル|仮)(?:テキスト|文章)|(?:示例|占位|测试|填充)(?:文字|文本|内容)",
    re.I,
)
#: A reference numeral beside a part's name: the sentence tells of the apparatus.
NUMERAL = re.compile(
    r"\b(?!(?:code|no|id|proxy|line|after|http|error|fehler|erreur|claims?|ansprüche|revendications?)\b)[a-zà-ÿ-]{3,} (?!4\d\d|5\d\d)\d{1,3}\b(?! (?:ms|s)\b)|\((?!4\d\d|5\d\d)\d{1,3}\)|[\u3040-\u30ff\u4e00-\u9fff](?!4\d\d|5\d\d)\d{1,3}(?=[\u3040-\u30ff\u4e00-\u9fff])",
    re.I,
)
_QUOTES = "\"'“”„‘’‚「」『』"
_ABOUT = re.compile(r"(?:variables?|platzhalter|field|felder?|champs?|变量|変数|フィールド|字段)[^.。]{0,24}$|[\"“„«「『]\s*$", re.I)
_COUNTER = re.compile(r"^\s*\[\d+\]|^\s*\d+[.)]")


def placeholder(unit: str, at: int | None = None) -> re.Match | None:
    return PLACEHOLDER.match(unit, at) if at is not None else PLACEHOLDER.search(unit)


#: One or two words said four times in a row.
_AGAIN = re.compile(r"\b([^\W\d]{2,12}(?: [^\W\d]{2,5})?)(?:[\s,.]+\1\b){3}", re.I)


def _repeats(unit: str) -> bool:
    words = unit.lower().replace(",", " ").replace(".", " ").split()
    return any(a == b for a, b in zip(words, words[1:])) or any(a == b for a, b in zip(words, words[2:]))


def phrase(unit: str) -> re.Match | None:
    found = next((m for m in (p.search(unit) for p in (STATUS, SCRIPT, NOTICE, FILLER)) if m), None)
    return found or (_AGAIN.search(unit) if _repeats(unit) else None)


#: The same phrases without word boundaries, for a linear-time scan: a unit that it does not match
#: has no phrase but perhaps a repetition.
_SCAN = "(?i)" + "|".join(p.pattern.replace(r"\b", "") for p in (STATUS, SCRIPT, NOTICE, FILLER))
_OPEN = r"[{<%@«【〔［\[#$]|__|XXX|\*\*\*"


def may_label(units: list[str]) -> np.ndarray:
    """Whether ``weak_label`` may be other than 0 for each sentence; scanned as a whole."""
    texts = pa.array(units, pa.string())
    hit = pc.or_(pc.match_substring_regex(texts, _SCAN), pc.match_substring_regex(texts, _OPEN))
    return np.asarray(hit) | np.fromiter(map(_repeats, units), bool, len(units))


def weak_label(unit: str, at: int | None = None) -> int:
    """1 residue, -1 a mention of it, 0 neither. ``at``: where a window's opener stands in it."""
    hit = placeholder(unit, at)
    if hit:
        return -1 if _ABOUT.search(unit[: hit.start()]) or unit[hit.end() : hit.end() + 1] in tuple(_QUOTES) else 1
    return phrase_label(unit) if at is None else 0


def phrase_label(unit: str) -> int:
    """The label that a sentence's phrases give it, whatever placeholders it holds."""
    hit = phrase(unit)
    if not hit:
        return 0
    before, after = unit[: hit.start()], unit[hit.end() - 1 :]
    quoted = any(q in before and q in after for q in "\"'‘“”„「『")
    return -1 if quoted or NUMERAL.search(_COUNTER.sub("", unit)) else 1
