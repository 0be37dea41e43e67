"""Credentials in source text, found and redacted by a conditional random field.

Lines are cut into lexical tokens; a linear-chain CRF over shape, format and context features
labels each token outside or secret; Viterbi spans say exactly which characters of a literal
are replaced. The model is trained here, on lines written by a seeded generator (keys, values
and statements of its own in ten notations, with credentials, samples, references, masked
values and hashes), so that every label is known. An exact check of form follows: a span that
is a reference, blotted out or a documentation sample, or a key mark without a key body, is
no credential. What words a value is made of is for the model to weigh.
"""

from __future__ import annotations

import base64
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_few, spread, table
from .crf import LinearChainCRF, feature_ids
from .secret_lexer import _PEM, WORTH, Token, format_of, key_material, looked_up, part_names, small, token_features, token_parts, tokens, unusable

#: Lines the model is trained on, and the seed they are written with.
TRAIN_LINES, SEED = 10_000, 20
MASK = "REDACTED"
_BREAK = re.compile(r"\r\n|\n|\r")
#: A line of a key's body: base64 only, beside a comment's lead, quotes and what joins literals.
_BODY = re.compile(r"\s*+(?:(?:#|//|\*|;|--|>|\|)\s++)?(?:\\[nr])*+[\"'`]?(?=[+/=]*+[A-Za-z0-9])([A-Za-z0-9+/=]++)(?:\\[nr])*+[\"'`]?\s*+[+,;.)\\]*+\s*+$")


class Secret(NamedTuple):
    line_no: int
    start: int  # offsets in the text
    end: int
    rule: str
    counts: bool  # false for what belongs to a key reported at its BEGIN mark


# --- training lines -----------------------------------------------------------------------

_SECRET_KEYS = (
    "password passwd pwd db_password admin_password smtp_pass redis_pass user_pwd passphrase keystore_password secret secret_key client_secret app_secret "
    "api_key apikey api_token access_token auth_token refresh_token private_token signing_secret webhook_secret encryption_key aws_secret_access_key "
    "aws_access_key_id token login_password service_password jwt_secret session_secret private_key deploy_token master_key db_pass root_password bot_token"
).split()
_PLAIN_KEYS = "remote upstream endpoint deploy bot session mirror k1 auth publish_with ci_access value target primary handle client connection".split()
_NEUTRAL_KEYS = (
    "token_type password_min_length password_reset_ttl secret_name api_key_header api_key_id password_hash_scheme token_count key_length secret_path auth_type auth_header_name "
    "checksum digest integrity etag commit image_sha build_id request_id tenant_id revision sha256 git_ref trace_id session_id public_key_id"
).split()
_WORDS = "amber basalt cedar delta ember fjord garnet hollow indigo jasper kestrel lumen meadow nickel onyx pebble quartz raven sable timber umber vesper willow xenon yarrow zephyr".split()
_PLACES = (
    "changeme change-me placeholder REPLACE_ME REDACTED none null example-{w}-value your-{w}-key-here <your-{w}-password> <{w}> dummy{n} dummy-password fake_{w}_secret not-a-real-secret "
    "insert_{w}_token_here TODO-set-in-vault set-by-ci change-this-before-deploy ${{{K}}} %{K}% {{{{ vault_{K} }}}} $(read_secret {K}) [removed by {w}] xxxxxxxxxxxx ******** *************** ${K} <password> secret password true"
).split(" ")


class Writer:
    """Writes labelled lines. A secret part is wrapped in \\x01..\\x02 while a line is built."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chars(self, n: int, of: str) -> str:
        return "".join(self.r.choice(of) for _ in range(n))

    def vendor(self) -> str:
        an, hx, up, w = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"
        c = self.chars
        jw = lambda n: base64.urlsafe_b64encode(c(n, an).encode()).decode().rstrip("=")
        return self.r.choice(
            [
                lambda: self.r.choice(["AKIA", "ASIA", "AGPA"]) + c(16, up), lambda: self.r.choice(["ghp_", "gho_", "ghs_", "ghr_"]) + c(36, an), lambda: "github_pat_" + c(22, an) + "_" + c(59, an),
                lambda: "glpat-" + c(20, w), lambda: self.r.choice(["sk_live_", "rk_live_"]) + c(24, an), lambda: f"xoxb-{c(11, string.digits)}-{c(24, an)}", lambda: "AIza" + c(35, w),
                lambda: "npm_" + c(36, an), lambda: "pypi-AgEIcHlwaS" + c(50, w), lambda: "rubygems_" + c(48, hx), lambda: f"SG.{c(22, w)}.{c(43, w)}", lambda: "SK" + c(32, hx), lambda: "dop_v1_" + c(64, hx),
                lambda: "shpat_" + c(32, hx), lambda: "sq0atp-" + c(22, w), lambda: f"PMAK-{c(24, hx)}-{c(34, hx)}", lambda: "NRAK-" + c(27, up), lambda: "dapi" + c(32, hx), lambda: "dp.pt." + c(42, an),
                lambda: "hf_" + c(34, an), lambda: "lin_api_" + c(40, an), lambda: "figd_" + c(42, w), lambda: c(32, hx) + "-us" + c(1, string.digits), lambda: "sbp_" + c(40, hx), lambda: "pul-" + c(40, hx), lambda: "glc_" + c(40, an),
                lambda: f"eyJ{jw(24)}.eyJ{jw(40)}.{c(43, w)}", lambda: "sk-proj-" + c(48, an), lambda: c(9, string.digits) + ":AA" + c(33, w), lambda: c(86, an + "+/") + "==",
            ]
        )()

    def password(self) -> str:
        r, w = self.r, self.r.choice(_WORDS)
        made = "".join(r.choice("bcdfgklmnprst") + r.choice(["a", "e", "ou", "ia"]) for _ in range(3))
        return r.choice(
            [
                lambda: f"{w.title()}{r.choice('-_.!#$')}{r.choice(_WORDS)}{r.randint(10, 999)}", lambda: f"{w}-{made}-{r.choice(_WORDS)}-{r.randint(1, 99)}", lambda: self.chars(r.randint(9, 22), string.ascii_letters + string.digits + "!#$%^*+-_"),
                lambda: f"{made.title()}{r.choice('_.-$!')}{r.randint(100, 9999)}", lambda: w.replace("a", "4").replace("e", "3") + "_" + r.choice(_WORDS).replace("o", "0") + r.choice("xyz!"), lambda: self.chars(r.randint(12, 18), string.ascii_letters + string.digits),
            ]
        )()

    def generic(self) -> str:
        r = self.r
        return r.choice(
            [lambda: self.chars(r.choice([32, 40]), "0123456789abcdef"), lambda: self.chars(r.randint(20, 40), string.ascii_letters + string.digits), lambda: self.chars(r.randint(28, 40), string.ascii_letters + string.digits + "_-"), lambda: self.chars(r.choice([32, 40]), string.ascii_letters + string.digits + "+/")]
        )()

    def place(self, key: str) -> str:
        v = self.r.choice(_PLACES).replace(" ", " ")
        return v.format(w=self.r.choice(_WORDS), n=self.r.randint(1, 99), K=key.upper())

    def sample(self) -> str:
        r = self.r
        return r.choice([lambda: "AKIA" + self.chars(9, string.ascii_uppercase) + "EXAMPLE", lambda: "ghp_" + "x" * 36, lambda: "npm_" + "0" * 36, lambda: "xoxb-your-bot-token-here", lambda: "sk_live_your_key_goes_here_00", lambda: "hf_" + "*" * 30, lambda: "AKIA" + "X" * 16, lambda: "AIza" + "*" * 31])()

    def hashed(self) -> str:
        r, h = self.r, "0123456789abcdef"
        return r.choice([lambda: self.chars(r.choice([32, 40, 64]), h), lambda: "sha512-" + base64.b64encode(self.r.randbytes(64)).decode(), lambda: "-".join(self.chars(n, h) for n in (8, 4, 4, 4, 12)), lambda: "sha256:" + self.chars(64, h)])()

    def neutral(self) -> str:
        return self.r.choice([self.r.choice(["bearer", "30d", "12", "true", "bcrypt", "prod/db/main", "X-Api-Key", "basic", "3600"]), self.hashed(), self.hashed(), self.r.choice(_WORDS)])

    def style(self, key: str) -> str:
        r = self.r
        camel = re.sub(r"_(\w)", lambda m: m[1].upper(), key)
        return r.choice([key, key.upper(), camel, key.replace("_", "-")])

    def put(self, key: str, v: str) -> str:
        """A statement in some notation that gives `key` the value `v`."""
        r, k = self.r, self.style(key)
        q = r.choice("\"'") if '"' not in v and "'" not in v else '"'
        ident = k.replace("-", "_")
        forms = [
            f"{ident} = {q}{v}{q}", f"const {ident} = {q}{v}{q};", f"let {ident} = `{v}`;", f'  "{k}": "{v}",', f"{k}: {q}{v}{q}", f"{k.upper().replace('-', '_')}={q}{v}{q}", f"export {ident.upper()}={q}{v}{q}", f"options.{ident} = {q}{v}{q};",
            f'settings["{k}"] = "{v}"', f'os.environ.setdefault("{k}", "{v}")', f'props.setProperty("{k}", "{v}");', f'private static final String {ident} = "{v}";', f'<property name="{k}" value="{v}"/>', f'<entry key="{k}">{v}</entry>', f"<{ident}>{v}</{ident}>", f"run --{k}={q}{v}{q} -u root", f"module.exports.{ident} = '{v}';",
            f"{ident.upper()}={v}", f"{k} = {v}", f"{k}: {v}", f"  {k}: {v}", f"export {ident.upper()}={v}", f"  {ident.lower()} = {v}", f'{k}: "{v}"',
        ]
        return r.choice(forms)

    def passed(self) -> str:
        """A credential, or something else, as an argument of a call or command."""
        r = self.r
        S = lambda v: f"\x01{v}\x02"
        w, v, n = r.choice(_WORDS), r.choice(_WORDS), r.randint(1, 99)
        user, host = r.choice(["root", "admin", "app", "svc", w]), f"db.{v}.example"
        pw = re.sub(r"[\"'`$\\<>%]", "7", self.password())
        bare = re.sub(r"[^A-Za-z0-9_.-]", "7", pw)
        q = r.choice("\"'")
        do = r.choice(["connect", "login", "signIn", "log_in", "authenticate", "auth"])
        token = self.vendor()
        cut = r.randint(4, len(token) - 3)
        return r.choice(
            [
                lambda: f"{w}.{do}({q}{user}{q}, {q}{S(pw)}{q})", lambda: f"{do}({q}{user}{q}, {q}{S(pw)}{q});", lambda: f"const {w} = new Client({q}{host}{q}, {q}{user}{q}, {q}{S(pw)}{q});",
                lambda: f"{w} = Session.{do}({q}{host}{q}, {q}{user}{q}, {q}{S(pw)}{q})", lambda: f"requests.get(url, auth=HTTPBasicAuth({q}{user}{q}, {q}{S(pw)}{q}))",
                lambda: f"redis-cli -a {S(bare)} ping", lambda: f"sshpass -p {q}{S(pw)}{q} ssh {user}@{host}", lambda: f"deploy --token {S(bare)} --env {v}",
                lambda: f"const {w} = [{q}{S(token[:cut])}{q}, {q}{S(token[cut:])}{q}].join({q}{q});",
                lambda: f"{w}.connect({q}{host}{q}, {q}{v}{q})", lambda: f"{do}({q}{user}{q}, {q}{v}{q})", lambda: f"{do}({q}{user}{q}, {v})", lambda: f"redis-cli -h {host} ping", lambda: f"redis-cli -a $REDIS_PASS ping", lambda: f"sshpass -p {q}<password>{q} ssh {user}@{host}",
                lambda: f"{w}.put({q}{v}{q}, {n});", lambda: f"route({q}{w}{q}, {q}{v}-detail{q});", lambda: f"[{q}{w}{q}, {q}{v}{q}].join({q}-{q})", lambda: f"check({q}{w}{q}, {q}v{n}.{n}.2{q})", lambda: f"assertEquals({q}{w}{q}, {q}{self.hashed()}{q})",
                lambda: f"{w}.get({q}{v}{n}{q})", lambda: f"say({q}{w} {v}!{q}, {n})", lambda: f"open({q}{w}-{n}.json{q})", lambda: f"render({q}{w}{n}{v}{q}, {q}#{self.chars(6, '0123456789abcdef')}{q})",
            ]
        )()

    def line(self) -> str:
        r = self.r
        if r.random() < 0.06:
            return self.passed()
        S = lambda v: f"\x01{v}\x02"
        sk, pk, nk = r.choice(_SECRET_KEYS), r.choice(_PLAIN_KEYS), r.choice(_NEUTRAL_KEYS)
        user, host = r.choice(_WORDS), f"db.{r.choice(_WORDS)}.example"
        scheme = r.choice(["postgres", "mysql", "amqp", "https", "redis", "mongodb+srv"])
        x = r.random()
        if x < 0.14:
            return self.put(r.choice([sk, pk, pk]), S(self.vendor()))
        if x < 0.27:
            return self.put(r.choice([k for k in _SECRET_KEYS if "pass" in k or "pwd" in k]), S(self.password()))
        if x < 0.36:
            return self.put(r.choice([k for k in _SECRET_KEYS if "pass" not in k and "pwd" not in k]), S(self.generic()))
        if x < 0.50:
            return self.put(sk, self.place(sk))
        if x < 0.55:
            return self.put(r.choice([sk, pk]), self.sample())
        if x < 0.66:
            return self.put(nk, self.neutral())
        if x < 0.71:
            return self.put(r.choice(["database_url", "dsn", "broker", pk]), f"{scheme}://{user}:{S(self.password().replace('@', '').replace('/', '').replace('#', ''))}@{host}{r.choice([':5432/app', '/main', ''])}")
        if x < 0.76:
            return self.put(r.choice(["database_url", "dsn", pk]), f"{scheme}://{user}:{r.choice(['****', '<password>', '${DB_PASSWORD}', '{{ pass }}', '%PASS%'])}@{host}:5432/app")
        if x < 0.80:
            return self.put(r.choice(["authorization", "auth_header", "proxy_auth"]), "Basic " + S(base64.b64encode(f"{user}:{self.password()}".encode()).decode()))
        if x < 0.82:
            v = self.vendor()
            cut = r.randint(6, len(v) - 4)
            q = r.choice("\"'")
            return f"{r.choice(['const ', 'let ', ''])}{self.style(r.choice([sk, pk])).replace('-', '_')} = {q}{S(v[:cut])}{q} + {q}{S(v[cut:])}{q};"
        if x < 0.86:
            v = S(self.vendor())
            return r.choice(["#", "//", ";", "--"]) + " " + r.choice([f"was: {v}", f"old value {v} kept for rollback", f"use {v} until rotation", f"temporary {v}"])
        if x < 0.89:
            return r.choice([f'curl -H "Authorization: Bearer {S(self.vendor())}" https://{host}/v1', f"curl -u {user}:'{S(self.password())}' https://{host}/put", f'curl -H "Authorization: Bearer $TOKEN" https://{host}', f"curl -u {user}:$PASS https://{host}"])
        if x < 0.91:
            return self.put("connection", f"Server={host};User Id=app;Password={S(self.password().replace(';', '').replace('=', ''))};Pooling=true")
        if x < 0.94:
            body = "\\n".join(self.chars(64, string.ascii_letters + string.digits + "+/") for _ in range(3))
            kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
            if r.random() < 0.7:
                return self.put(r.choice(["deploy_key", "tls_key", "signing_key"]), S(f"-----BEGIN {kind}-----") + S(f"\\n{body}\\n") + f"-----END {kind}-----")
            if r.random() < 0.5:
                return self.put("deploy_key", f"-----BEGIN {kind}-----\\n...\\n-----END {kind}-----")
            kind = r.choice(["PUBLIC KEY", "CERTIFICATE"])
            return self.put("ca", f"-----BEGIN {kind}-----\\n{body}\\n-----END {kind}-----")
        w = r.choice(_WORDS)
        return r.choice(
            [
                f"{sk} = os.environ['{sk.upper()}']", f"const {sk} = process.env.{sk.upper()};", f'String {sk} = System.getenv("{sk.upper()}");', f"{w} = load_{r.choice(_WORDS)}({r.randint(1, 900)})", f"token = next(tokens)", f"if (password.length < {r.randint(6, 20)}) fail();",
                f"log.info('{w} token %s', {w})", f"def check_password({w}, limit={r.randint(1, 99)}): return {w}[:limit]", f"import {w}", f"const {w} = require('@{w}/auth-token');", f"auth.on('{w}', () => {w}({r.randint(1, 99)}));", f"// {w} the api key header in workspaces", f'"{w}": ["{w}", "secret-{w}"],',
                f"match: {self.hashed()}", self.hashed(), f"{r.choice(_WORDS)}-mode: /srv/{w}",
            ]
        )


def labelled(line: str) -> tuple[str, list[tuple[int, int]]]:
    """The line without its marks, and the marked ranges."""
    out, spans, start = [], [], 0
    for ch in line:
        if ch == "\x01":
            start = len(out)
        elif ch == "\x02":
            spans.append((start, len(out)))
        else:
            out.append(ch)
    return "".join(out), spans


def _block_lines(w: Writer) -> list[tuple[str, str, bool, list[tuple[int, int]]]]:
    """(line, block, body next, secret ranges) of a key or certificate spread over lines."""
    r = w.r
    kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "PUBLIC KEY", "CERTIFICATE"])
    private, full = "PRIVATE" in kind, r.random() < 0.7
    pad = r.choice(["", "  ", "    "])
    block = "private" if private else "public"
    head = f"{pad}-----BEGIN {kind}-----"
    rows = [(head, "none", full, [(len(pad), len(head))] if private and full else [])]
    for _ in range(r.randint(2, 4) if full else 1):
        line = pad + (w.chars(64, string.ascii_letters + string.digits + "+/") if full else "...")
        rows.append((line, block, False, [(len(pad), len(line))] if private and full else []))
    rows.append((f"{pad}-----END {kind}-----", block, False, []))
    return rows


@lru_cache(maxsize=2)
def trained(lines: int = TRAIN_LINES, seed: int = SEED) -> LinearChainCRF:
    """The model, fitted on `lines` generated lines."""
    w = Writer(seed)
    seqs, labels = [], []

    def add(line: str, block: str, body_next: bool, spans: list[tuple[int, int]]) -> None:
        toks = tokens(line)
        seqs.append([feature_ids(f) for f in token_features(toks, line, block, body_next)])
        labels.append([int(t.kind != "punct" and any(a <= t.start and t.end <= b for a, b in spans)) for t in toks])

    for i in range(lines):
        if i % 25 == 0:
            for row in _block_lines(w):
                add(*row)
        else:
            line, spans = labelled(w.line())
            if w.r.random() < 0.1:
                lead = f"src/{w.r.choice(_WORDS)}.py:{w.r.randint(1, 40)} "
                line, spans = lead + line, [(a + len(lead), b + len(lead)) for a, b in spans]
            add(line, "none", False, spans)
    return LinearChainCRF().fit(seqs, labels)


# --- labelling texts ----------------------------------------------------------------------


def _is_secret(t: Token, block: str, body_next: bool, inline: bool) -> bool:
    """The exact check after decoding."""
    if t.kind == "pem":
        m = _PEM.search(t.text)
        return bool(m) and m[1] == "BEGIN" and m[2].endswith(("PRIVATE KEY", "PRIVATE KEY BLOCK")) and (body_next or inline)
    if t.kind == "body":
        return key_material(t.text)
    if block != "none":
        return block == "private" and key_material(t.text)
    return len(t.text) >= 3 and not unusable(t.text)


def line_secrets(crf: LinearChainCRF, line: str, block: str = "none", body_next: bool = False) -> list[tuple[int, int, str, bool]]:
    """(start, end, rule, counts) of the secret spans of one line."""
    toks = tokens(line)
    if not toks:
        return []
    names = looked_up(line)
    path = crf.decode(token_parts(toks, line, block, body_next), part_names)
    out = []
    for i, (t, y) in enumerate(zip(toks, path)):
        if not y or t.kind == "punct":
            continue
        inline = i + 1 < len(toks) and toks[i + 1].kind == "body" and key_material(toks[i + 1].text)
        if t.start in names or not _is_secret(t, block, body_next, inline):
            continue
        body = t.kind == "body" or block == "private"
        rule = "private-key" if t.kind == "pem" or body else format_of(t.text) or ("basic-auth-url" if t.kind == "pass" else "generic-secret")
        out.append((t.start, t.end, rule, not body))
    return out


def key_body(text: str, bounds: list[tuple[int, int]], no: int, mark: re.Match, at: int) -> tuple[bool, dict[int, tuple[int, int]]]:
    """Whether key material follows the BEGIN mark `mark`, the last of line `no` (`at`: where that
    line starts), and by line the base64 stretch of each body line. Up to the key's END mark
    every base64 line is body, however short; without one, those up to another line are."""
    spans: list[tuple[int, int, int]] = []
    first = other = gap = None  # line that decides alone; body lines before another line, before a blank one
    closed = False
    if got := _BODY.match(text, at + mark.end(), bounds[no - 1][1]):
        spans.append((no, *got.span(1)))
    for n in range(no, len(bounds)):
        c, d = bounds[n]
        end = _PEM.search(text, c, d) if text.find("-----", c, d) >= 0 else None
        if got := _BODY.match(text, c, end.start() if end else d):
            spans.append((n + 1, *got.span(1)))
        elif not end and not text[c:d].strip():
            gap = len(spans) if spans and gap is None else gap
            continue
        following = text[c:d].strip().strip("\"'`+,;\\ ").removesuffix("\\n")
        header = re.match(r"[A-Za-z-]+: ", following)
        if first is None and following and not header:
            first = key_material(following)
        if end:
            closed = end[1] == "END" and end[2] == mark[2]
            break
        if not got and not header and other is None:
            other = len(spans)
    run = spans[:other] if closed else spans[: min((x for x in (other, gap) if x is not None), default=None)]
    whole = "".join(text[s:e] for _, s, e in run)
    return bool(first) or key_material(whole) and len(set(whole)) > 2, {n: (s, e) for n, s, e in (spans if closed else run)}


def worth_lines(text: str, bounds: list[tuple[int, int]]) -> set[int]:
    """Numbers of the lines that are decoded: those `WORTH` finds something in."""
    hot, at, no = set(), 0, 0
    low = small(text)
    while m := WORTH.search(low, at):
        no = bisect_right(bounds, (m.start(), len(text) + 1), no)
        hot.add(no)
        if bounds[no - 1][1] < m.end():  # a match over several lines
            hot.update(range(no, bisect_right(bounds, (m.end(), 0), no) + 1))
        if no == len(bounds):
            break
        at = bounds[no][0]
    return hot


def text_secrets(crf: LinearChainCRF, text: str) -> list[Secret]:
    """Every secret span of a text, by line; lines end at \\r\\n, \\n or \\r."""
    bounds, at = [], 0
    for m in _BREAK.finditer(text):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(text)))
    out = []
    block, body = "none", {}
    marked = "-----" in text
    hot = worth_lines(text, bounds)
    for no in range(1, len(bounds) + 1) if marked else sorted(hot):
        a, b = bounds[no - 1]
        line = text[a:b]
        body_next = False
        marks = list(_PEM.finditer(line)) if "-----" in line else []
        ours = body.get(no)
        if marks and marks[-1][1] == "BEGIN":
            body_next, body = key_body(text, bounds, no, marks[-1], a)
            if "PRIVATE" not in marks[-1][2] or not (body_next or key_material(line[marks[-1].end() :])):
                body = {}
            ours = ours or body.get(no)
        found = [Secret(no, a + s, a + e, rule, counts) for s, e, rule, counts in line_secrets(crf, line, block, body_next)] if no in hot or block != "none" else []
        out += joined([*found, Secret(no, *ours, "private-key", False)]) if ours else found
        if marks:
            block = "none" if marks[-1][1] == "END" else "private" if "PRIVATE" in marks[-1][2] else "public"
    return out


def redact(text: str, found: list[Secret]) -> str:
    """The text with the literal characters of every span replaced; quotes, keys and the
    marks around a key body stay."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: s.start):
        if s.start < at or s.rule == "private-key" and s.counts:
            continue
        out += [text[at : s.start], MASK]
        at = s.end
    return "".join(out) + text[at:]


def joined(found: list[Secret]) -> list[Secret]:
    """Spans of several readings of one text: of those that overlap, one that covers them all.
    Marks of private keys, which stay in the text, are kept apart."""
    out: list[Secret] = []
    for mark in (False, True):
        last = None
        for s in sorted((s for s in found if (s.rule == "private-key" and s.counts) == mark), key=lambda s: (s.start, -s.end)):
            if last is not None and s.start < out[last].end:
                out[last] = out[last]._replace(end=max(out[last].end, s.end))
            else:
                last = len(out)
                out.append(s)
    return sorted(out, key=lambda s: s.start)


def find_secrets(df: DataFrame, row_id: str, text: str, with_text: bool = False) -> DataFrame:
    """(row_id, line_no, start, end, rule, counts) of every secret span in column `text`;
    with `with_text`, instead (row_id, redacted, spans) of every row.

    Null and empty texts hold nothing; rows with a null id are kept apart by nothing and so
    left out of the spans; repeated rows are reported each. Whole texts are read. No shuffle
    beyond spreading an input of few files.
    """
    crf = trained()
    held = df.sparkSession.sparkContext.broadcast((crf.w, crf.trans, crf.start))
    src = spread(df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("row_id is not null"))

    def model() -> LinearChainCRF:
        m = LinearChainCRF()
        m.w, m.trans, m.start = held.value
        return m

    if with_text:

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = model()
            for pdf in batches:
                got = [(i, *((None, 0) if t is None else (redact(t, f := text_secrets(m, t)), len(f)))) for i, t in zip(pdf["row_id"], pdf["text"])]
                yield pd.DataFrame(got, columns=["row_id", "redacted", "spans"])

        return src.mapInPandas(rows, "row_id bigint, redacted string, spans int")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            found = {t: text_secrets(m, t) for t in set(pdf["text"])}  # one content stands at several commits
            got = [(i, *s) for i, t in zip(pdf["row_id"], pdf["text"]) for s in found[t]]
            yield pd.DataFrame(got, columns=["row_id", "line_no", "start", "end", "rule", "counts"])

    return src.where("text is not null and text <> ''").mapInPandas(spans, "row_id bigint, line_no int, start int, end int, rule string, counts boolean")


# --- queries ------------------------------------------------------------------------------

_LEAD = r"^(match: |[\w./-]+:[0-9]+ )"
#: A preview that shows a value only: no assignment, quote, address or scheme around it.
_BARE = r"^\S+$|^\S+\(\S*( \S*)?\)$"


def preview_lines(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(match_id, preview, shown, text) of every preview, once each: the part that shows
    something, and the text it is judged by. A bare value says nothing about what it is, so
    where the file's line still holds it, that line stands in, else the value under its
    pattern's name; what counts is only what `preview_secrets` finds of it in `shown`."""
    m = matches.where("match_id is not null and preview is not null").select("match_id", "file_id", "line", "preview", "pattern_id", "kind").distinct()
    shown = F.regexp_replace("preview", _LEAD, "")
    m = m.withColumn("shown", shown)
    bare = shown.rlike(_BARE) & ~shown.contains("=") & ~shown.contains("://") & ~shown.contains("****") & (F.length(shown) >= 6)
    files = files.select("file_id", "content")
    asked = m.where(bare)
    # the contents that are asked for are picked before they are shuffled, if their ids are few
    held = files.join(broadcast_few(asked.select("file_id").distinct()), "file_id", "left_semi").dropDuplicates(["file_id"])
    found = asked.join(held, "file_id", "left")
    source = F.try_element_at(F.split("content", r"\r\n|\n|\r"), F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).cast("int"))
    named = F.concat(F.coalesce(F.regexp_replace(F.lower("pattern_id"), "_", "-"), F.col("kind"), F.lit("value")), F.lit(': "'), F.col("shown"), F.lit('"'))
    context = F.when(F.contains(source, F.col("shown")), source).otherwise(named)
    texts = m.where(~bare).select("match_id", "preview", "shown", F.col("shown").alias("text"))
    return texts.unionByName(found.select("match_id", "preview", "shown", context.alias("text"))).distinct()


def preview_secrets(crf: LinearChainCRF, preview: str, shown: str, text: str) -> list[Secret]:
    """The spans of `text` that reach into `shown`, as spans of the preview, which ends in it."""
    lead, got = len(preview) - len(shown), set()
    if found := text_secrets(crf, text):
        at = text.find(shown)
        while at >= 0:
            for s in found:
                a, b = max(s.start, at), min(s.end, at + len(shown))
                if a < b:
                    got.add(s._replace(start=a - at + lead, end=b - at + lead))
            at = text.find(shown, at + 1)
    return sorted(got, key=lambda s: (s.start, -s.end))


def find_preview_secrets(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, preview, start, end, rule, counts) of every secret span of every preview.

    Rows of one `match_id` and preview that lie in different lines give the spans of each.
    """
    crf = trained()
    held = matches.sparkSession.sparkContext.broadcast((crf.w, crf.trans, crf.start))
    src = spread(preview_lines(matches, files).select(F.col("match_id").cast("bigint").alias("row_id"), "preview", "shown", "text"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LinearChainCRF()
        m.w, m.trans, m.start = held.value
        for pdf in batches:
            got = [(i, p, s.start, s.end, s.rule, s.counts) for i, p, w, t in zip(pdf["row_id"], pdf["preview"], pdf["shown"], pdf["text"]) for s in preview_secrets(m, p, w, t)]
            yield pd.DataFrame(got, columns=["row_id", "preview", "start", "end", "rule", "counts"])

    return src.mapInPandas(spans, "row_id bigint, preview string, start int, end int, rule string, counts boolean")


def redact_previews(matches: DataFrame, files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep.., redacted, spans) of every distinct (match_id, preview, keep..) of the
    matches; null previews stay null."""
    found = find_preview_secrets(matches, files).groupBy("row_id", "preview").agg(F.collect_set(F.struct("start", "end", "rule", "counts")).alias("found"))
    every = matches.where("match_id is not null").select(F.col("match_id").cast("bigint").alias("row_id"), "preview", *[F.col(k).cast("string").alias(f"keep_{k}") for k in keep]).distinct()
    names = [f"keep_{k}" for k in keep]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for p, found in zip(pdf["preview"], pdf["found"]):
                f = joined([Secret(1, s["start"], s["end"], s["rule"], s["counts"]) for s in (() if found is None else found)])
                got.append((None if p is None else redact(p, f), len(f)))
            yield pd.concat([pdf[["row_id", *names]].reset_index(drop=True), pd.DataFrame(got, columns=["redacted", "spans"])], axis=1)

    out = every.join(found, ["row_id", "preview"], "left").mapInPandas(rows, "row_id bigint, " + "".join(f"`{n}` string, " for n in names) + "redacted string, spans int")
    return out.select("row_id", *[F.col(n).alias(k) for n, k in zip(names, keep)], "redacted", "spans")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(origin, row_id, line_no) of every line that shows a usable credential in full."""
    files = find_secrets(table(spark, root, "source_files"), "file_id", "content")
    shown = find_preview_secrets(table(spark, root, "file_secret_matches"), table(spark, root, "source_files"))
    return (
        files.where("counts").select(F.lit("source_files").alias("origin"), "row_id", "line_no")
        .unionByName(shown.where("counts").select(F.lit("file_secret_matches").alias("origin"), "row_id", F.lit(1).alias("line_no")))
        .distinct()
    )


def p1_redacted_files(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, redacted, spans): the content of every source file without credentials."""
    return find_secrets(table(spark, root, "source_files"), "file_id", "content", with_text=True)


def p1_redacted_previews(spark: SparkSession, root: str) -> DataFrame:
    """(row_id, pattern_id, commit, redacted, spans): every preview without the credentials that
    `p1_found` sees in it."""
    return redact_previews(table(spark, root, "file_secret_matches"), table(spark, root, "source_files"), ("pattern_id", "commit"))


def p1_left_readable(spark: SparkSession, root: str) -> DataFrame:
    """(origin, found, left_readable): files and previews in which `p1_found` sees a credential,
    and how many of them come out of redaction without any span, which should be none."""
    found = p1_found(spark, root).select("origin", "row_id").distinct()
    files = p1_redacted_files(spark, root).where("spans > 0").select(F.lit("source_files").alias("origin"), "row_id")
    shown = p1_redacted_previews(spark, root).where("spans > 0").select(F.lit("file_secret_matches").alias("origin"), "row_id")
    hidden = files.unionByName(shown).distinct().withColumn("hidden", F.lit(1))
    return found.join(hidden, ["origin", "row_id"], "left").groupBy("origin").agg(F.count("*").alias("found"), F.count_if(F.col("hidden").isNull()).alias("left_readable"))
