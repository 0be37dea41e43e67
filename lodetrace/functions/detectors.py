"""What install commands and JavaScript code do, as column expressions.

Code is cut into lexical tokens first: comments vanish, and a string or template stays one
token, so that nothing inside a comment or a string is taken for code. What is looked for are
sequences of tokens. Text whose brackets do not pair is not read as code at all. A slash is
never taken for the start of a regular expression; a quote within one ends at its line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hooks a package manager runs by itself around an install.
INSTALL_HOOKS = ["preinstall", "install", "postinstall", "preuninstall", "postuninstall", "prepare"]

# Labels of dangerous install commands and the patterns that define them.
SCRIPT_RULES = [
    ("downloads remote content (curl/wget)", r"\b(curl|wget)\b"),
    ("pipes downloaded content into a shell", r"\|\s*(sh|bash|zsh|node|python3?)\b"),
    ("inline code execution", r"\b(node|python3?|ruby|perl)\s+-e\b"),
    ("base64-decoded payload", r"base64\s+-{1,2}d|from\(['\"][^'\"]*['\"],\s*['\"]base64"),
    ("reads environment/secrets", r"process\.env|\$\{?(NPM_TOKEN|AWS_|GITHUB_TOKEN|SECRET)"),
    ("raw TCP / reverse shell", r"/dev/tcp/|\bnc\b\s+-|\bnetcat\b"),
    ("contacts a raw IP address", r"https?://\d{1,3}(\.\d{1,3}){3}"),
    ("destructive filesystem operation", r"\brm\s+-rf\s+[~/]"),
    ("marks a file executable", r"\bchmod\s+\+x\b"),
]

# Modules whose import is a signal, by the kind of signal.
MODULES = {
    "child-process": ["child_process", "node:child_process", "vm", "node:vm"],
    "network": ["http", "https", "net", "dgram", "dns", "tls", "node:http", "node:https", "node:net", "node:dns"],
}
SIGNALS = ["child-process", "dynamic-eval", "network", "env-access", "obfuscation"]

#: Between tokens, and before the first and after the last one.
SEP = "\x01"
#: Comments, strings, templates, names, numbers and single characters; possessive, so that long
#: literals are read without recursion.
TOKEN = (
    r"//[^\n\r]*+|/\*(?:[^*]|\*(?!/))*+\*/|\"(?:[^\"\\\n\r]|\\[\s\S])*+\"|'(?:[^'\\\n\r]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`|"
    r"[A-Za-z_$][\w$]*+|[0-9][\w.]*+|[^\s\w]"
)
_STRING = r"(?:\"[^\"\\\x01]+\"|'[^'\\\x01]+')"
#: What brings a module in: a call with a literal, or an import or export clause.
_BY_CALL = rf"(?:[^.]{SEP}require|{SEP}import){SEP}\({SEP}({_STRING}){SEP}"
_BY_CLAUSE = rf"{SEP}import{SEP}({_STRING}){SEP}"
_BY_FROM = rf"{SEP}(?:import|export){SEP}(?:[^;\"'`=()\x01]+{SEP})*?from{SEP}({_STRING}){SEP}"
_CALLS = {
    "dynamic-eval": [rf"[^.]{SEP}eval{SEP}\({SEP}", rf"{SEP}new{SEP}Function{SEP}"],
    "network": [rf"[^.]{SEP}fetch{SEP}\({SEP}"],
    "env-access": [rf"[^.]{SEP}process{SEP}(?:\.{SEP}env|\[{SEP}[\"']env[\"']{SEP}\]){SEP}"],
    "obfuscation": [rf"[^.]{SEP}Buffer{SEP}\.{SEP}from{SEP}\({SEP}(?:[^;\x01]+{SEP})*?[\"']base64[\"']{SEP}"],
}


def tokens(code: Column) -> Column:
    """The tokens of code in order, without comments; none if brackets do not pair."""
    found = F.filter(F.regexp_extract_all(code, F.lit(TOKEN), 0), lambda t: ~t.startswith("//") & ~t.startswith("/*"))
    count = lambda t, c: F.size(F.filter(t, lambda x: x == c))
    even = lambda t: (count(t, "(") == count(t, ")")) & (count(t, "[") == count(t, "]")) & (count(t, "{") == count(t, "}"))
    return F.element_at(F.transform(F.array(found), lambda t: F.when(even(t), t).otherwise(F.array().cast("array<string>"))), 1)


def lexed(code: Column) -> Column:
    """The tokens as one text, each between two `SEP`."""
    return F.concat(F.lit(";" + SEP), F.array_join(tokens(code), SEP), F.lit(SEP))


def _labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))


def script_labels(command: Column) -> Column:
    """What an install command does, in the order of the rules."""
    return _labels(command, SCRIPT_RULES)


def _modules(lex: Column) -> Column:
    quoted = F.flatten(F.array(*[F.regexp_extract_all(lex, F.lit(p), 1) for p in (_BY_CLAUSE, _BY_FROM, _BY_CALL)]))
    return F.transform(quoted, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def signal_counts(code: Column) -> Column:
    """map of kind of signal -> how often it occurs, of the kinds that occur: processes started,
    code evaluated, the network or the environment reached, payloads decoded."""

    def among(names: list[str]):
        return lambda m: m.isin(names)

    def counted(x: Column) -> Column:
        lex, mods = x["lex"], x["mods"]
        n = {k: F.lit(0) for k in SIGNALS}
        for k, names in MODULES.items():
            n[k] = n[k] + F.size(F.filter(mods, among(names)))
        for k, patterns in _CALLS.items():
            for p in patterns:
                n[k] = n[k] + F.regexp_count(lex, F.lit(p))
        every = F.array(*[F.struct(F.lit(k).alias("key"), n[k].cast("int").alias("value")) for k in SIGNALS])
        return F.map_from_entries(F.filter(every, lambda e: e["value"] > 0))

    one = F.transform(F.array(lexed(code)), lambda lex: F.struct(lex.alias("lex"), _modules(lex).alias("mods")))
    return F.element_at(F.transform(one, counted), 1)


def code_signals(code: Column) -> Column:
    """The kinds of signals in JavaScript code."""
    return F.map_keys(signal_counts(code))


def imported(code: Column) -> Column:
    """Specifiers of import, export-from, require and dynamic import with a literal."""
    return F.array_distinct(F.element_at(F.transform(F.array(lexed(code)), _modules), 1))
