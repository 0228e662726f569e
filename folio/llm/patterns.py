"""Patterns that serve as weak labels and as marks in features.

Fixed values: the grammar of unfilled placeholders, and phrases of filler,
error messages and requests for scripts in the languages of the pages.
"""

from __future__ import annotations

import re

_NAME = r"[^\W\d][\w.\-|:]*"
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}(?:\s*\|\s*\w+)*\s*\}}?\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|\{{%\s*[^%\n]{{1,60}}%\}}|<%=?\s*[^%\n]{{1,60}}%>"
    rf"|\[\[\s*{_NAME}\s*\]\]|\[%\s*{_NAME}\s*%\]|%%\s*{_NAME}\s*%%|%{_NAME}%|@@\s*{_NAME}\s*@@|__{_NAME}__|\{{{_NAME}\}}"
    r"|\[object object\]|\bnan / undefined\b|^undefined$|^(?:null ?)+$",
    re.I | re.M,
)
FILLER = re.compile(
    r"lorem ipsum|dolor sit amet|(?:\b(?:dolore?|eiusmod|tempor|incididunt|labore|magna|aliqua|minim|veniam|nostrud|ullamco|laboris|nisi|commodo|velit|esse|cillum|fugiat|nulla|excepteur|sint|occaecat|cupidatat|proident|culpa|officia|deserunt|mollit|anim|laborum|irure|sed|sit|quis|ut)\b\W*){4}|\b(?:asdf\s*){2,}|\b(?:tbd\s+){2,}|dummy (?:text|paragraph)|placeholder text|(?:story )?text will appear|sample text"
    r"|测试测试|占位|待补|示例文字|texte d.exemple|texto de exemplo|пример текста|текст[- ]заполнитель|サンプルテキスト|ダミー|見本の文",
    re.I,
)
MESSAGE = re.compile(
    r"could not find|cannot be found|page not found|no longer available|never here|do not have access|access (?:is )?denied|forbidden|resource unavailable"
    r"|http error|internal (?:server )?error|too many requests|rate limit|(?:enable|need\w*|turn on)[^.]{0,20}(?:javascript|js\b)|scripts are blocked|verifying that you|checking your browser|traceback|templatenotfound"
    r"|走丢了|已失效|被移除|页面不存在|没有查看|没有权限|访问过于频繁|开小差|数据库连接失败|需要脚本|禁用了js|校验您的浏览器"
    r"|introuvable\.|n.existe pas|accès refusé|erreur interne|trop de requêtes|activez javascript|scripts? (?:est|sont) bloqué|vérification de votre"
    r"|não foi encontrad|acesso negado|erro interno|muitas requisições|ative o javascript|bloqueia scripts|verificando seu"
    r"|не найдена?\b|доступ запрещ|внутренняя ошибка|слишком много запросов|включите javascript|скрипты отключ|проверяем ваш"
    r"|見つかりませんでした。|アクセスが拒否|内部エラー|javascriptを有効|スクリプトが無効|アクセスが集中|ブラウザを確認",
    re.I,
)

#: One of these stands wherever FILLER or MESSAGE has a match, but for FILLER's run of words, ...
_PHRASES = (
    "lorem ipsum|dolor sit amet|asdf|tbd|dummy |placeholder text|text will appear|sample text|测试测试|占位|待补|示例文字|texte d|texto de exemplo|пример текста|заполнитель|サンプルテキスト|ダミー|見本の文"
    "|could not find|cannot be found|page not found|no longer available|never here|do not have access|denied|forbidden|resource unavailable|http error|internal |too many requests|rate limit|javascript|js"
    "|scripts are blocked|verifying that you|checking your browser|traceback|templatenotfound|走丢了|已失效|被移除|页面不存在|没有查看|没有权限|访问过于频繁|开小差|数据库连接失败|需要脚本|校验您的浏览器"
    "|introuvable.|existe pas|accès refusé|erreur interne|trop de requêtes|bloqué|vérification de votre|não foi encontrad|acesso negado|erro interno|muitas requisições|bloqueia scripts|verificando seu"
    "|не найден|доступ запрещ|внутренняя ошибка|слишком много запросов|скрипты отключ|проверяем ваш|見つかりませんでした。|アクセスが拒否|内部エラー|スクリプトが無効|アクセスが集中|ブラウザを確認"
).split("|")
_LOW, _HIGH = bytes(range(128)), bytes(range(128, 256))
#: Bytes of these that a text holds if it does once all others are left out: those of ASCII if they tell enough, else those beyond.
_LOW_PHRASES = [b for x in _PHRASES if len(b := x.encode().translate(None, _HIGH)) >= 5 or x.isascii()]
_HIGH_PHRASES = [b.translate(None, _LOW) for x in _PHRASES if len((b := x.encode()).translate(None, _HIGH)) < 5 and not x.isascii()]
#: ... of which there are four; letters that a pattern takes for i, s or Cyrillic ones whatever their case.
_WORDS = frozenset(b"dolor dolore eiusmod tempor incididunt labore magna aliqua minim veniam nostrud ullamco laboris nisi commodo velit esse cillum fugiat nulla excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum irure sed sit quis ut".split())
_NO_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_HIGH_PHRASES += [x.encode() for x in "\u0131\u017f"] + ["\u1c80".encode()[:2]]


def may_tell(s: str) -> bool:
    """False only if neither FILLER nor MESSAGE has a match in any line of a text in lower case; far cheaper than both."""
    b = s.encode("utf-8", "surrogatepass")
    low = b.translate(None, _HIGH)
    for x in _LOW_PHRASES:
        if x in low:
            return True
    if len(low) < len(b):
        high = b.translate(None, _LOW)
        for x in _HIGH_PHRASES:
            if x in high:
                return True
    words = b.translate(_NO_LETTERS).split()
    return not _WORDS.isdisjoint(words) and sum(x in _WORDS for x in words) >= 4


def may_hold(s: str) -> bool:
    """False only if mask() leaves every line of a text in lower case as it is, and none holds U+0002."""
    return "{" in s or "%" in s or "[" in s or "@" in s or "<" in s or "__" in s or "null" in s or "undefined" in s or "nan /" in s or "\x02" in s


def mask(s: str) -> str:
    """The text with every placeholder as U+0002."""
    may = "{" in s or "%" in s or "[" in s or "@" in s or "<" in s or "__" in s
    if not may:
        low = s.lower()
        may = "null" in low or "undefined" in low or "nan /" in low
    return PLACEHOLDER.sub("\x02", s) if may else s
