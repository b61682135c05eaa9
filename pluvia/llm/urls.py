"""URL verdicts by pattern rules that are fetched by their rarest literal token.

A rule is written as filter lists write them: `||` starts at the host or one of its labels, `*` stands for any signs, `^`
for a separator or the end, a closing `|` for the end. Every run of letters and digits that is bounded on both sides by
other signs of the rule is one whole token of each URL that the rule fits. Spark counts how often those tokens occur in
the URLs; each rule is filed under its rarest one, a URL's tokens fetch the rules filed under them, and only these run
their regular expressions. A rule without such a token would be tried on every URL.

Rules of a host and path (`BASE`) come first, the longest of them wins. Else an allowing pattern wins over a blocking one,
and where none fits the page is allowed.

A null URL, and one without `://`, has an empty host and path, fits no rule and is allowed; repeated rows give equal
results; URLs may be of any length; an empty table gives an empty result; other columns stay, those named like an added
one are replaced. The rules are part of the call (a list on the driver, up to RULES of them), so what is sent to tasks is
bounded."""
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

RULES = 200_000   # rules a call takes at most
ADDED = "host string, path string, rule string, verdict string, pattern string"
# fixed values: host, path and verdict
BASE = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")

#: Hand-written patterns by topic: what is blocked, then the exceptions (after @@).
PATTERNS = """
||ads.*^
||ad.*^
||adserver.*^
||ads-track.*^
||adtrack.*^
||banners.*^
||click.*/redirect^
||track.*^
||tracker.*^
||tracking.*^
||pixel.*^
||beacon.*^
||telemetry.*^
||stats-collect.*^
||doubleclick.*^
||popads.*^
||popunder.*^
/adserver/
/ads/banner/
/ads/click/
/banner/ads/
/pagead/
/popunder/
/popup/ad/
/track/click^
/tracking/pixel^
/pixel.gif^
/beacon.gif^
/collect?*&tid=
?affiliate_id=
&affiliate_id=
||casino.*^
||casino-win.*^
||online-casino.*^
||free-bets.*^
||freebets.*^
||sports-bets.*^
||betting.*^
||jackpot.*^
||slots.*^
||poker.*^
||roulette.*^
||lottery-win.*^
/casino/
/slots/bonus^
/poker/bonus^
/betting/tips^
/free-spins^
||adult.*^
||adult-x.*^
||xxx.*^
||porn.*^
||sex-chat.*^
||sexcam.*^
||webcam-girls.*^
||escort.*^
||escorts.*^
||nude.*^
||hentai.*^
/adult/
/xxx/
/porn/
/escorts/
||cheap-pills.*^
||cheap-meds.*^
||viagra.*^
||cialis.*^
||online-pharmacy.*^
||pharmacy-discount.*^
||steroids.*^
||weight-loss.*^
/buy-viagra^
/cheap-pills/
/no-prescription^
||spam-farm.*^
||spam.*^
||link-farm.*^
||linkfarm.*^
||seo-links.*^
||backlinks.*^
||article-spinner.*^
||essay-writing.*^
||essay-mill.*^
||replica-watches.*^
||fake-id.*^
||payday-loan.*^
||payday-loans.*^
||quick-loan.*^
||get-rich.*^
||crypto-giveaway.*^
||free-iphone.*^
||prize-winner.*^
/payday-loan^
/make-money-fast^
/replica-watches/
/crypto-giveaway^
||malware.*^
||phishing.*^
||keygen.*^
||cracks.*^
||warez.*^
||torrent.*^
||torrents.*^
/keygen/
/warez/
/torrent/download^
/crack.exe|
/setup.exe|
/update.scr|
/wp-login.php^
/wp-admin/
/xmlrpc.php^
/phpmyadmin/
/cgi-bin/
/.git/config^
/.env^
/login?*&redirect=
/signin?*&redirect=
/logout^
/register?
/password/reset^
/cart/add^
/cart?
/checkout/
/my-account/
/wishlist/add^
/compare/add^
/print/preview^
/feed/rss^
/trackback/
/replytocom=
?replytocom=
&replytocom=
?sessionid=
&sessionid=
?phpsessid=
&phpsessid=
/calendar/day/
/search?q=
/tag/page/
/server-status^
/autodiscover/
/parked-domain^
/domain-for-sale^
/under-construction^
/404.html^
/403.html^
/500.html^
/captcha/
/robot-check^
@@||adult-education.*^
@@||adult-literacy.*^
@@||gambling-help.*^
@@||malware-research.*^
@@||phishing-report.*^
@@||spam-research.*^
@@/responsible-gambling/
@@/anti-spam/
@@/docs/tracking^
@@/docs/ads/
@@/help/login?
@@/help/checkout/
@@/robots.txt|
@@/ads.txt|
""".split()


@dataclass(frozen=True)
class Rule:
    text: str        # as it is shown
    regex: str       # searched in host, path and query
    verdict: str     # allow or block
    tokens: tuple    # whole tokens of every URL that it fits
    base: int = 0    # length of a host-and-path rule, else 0


def pattern_rule(line: str) -> Rule:
    body = line.removeprefix("@@").translate(_FOLD)
    anchored, ended = body.startswith("||"), body.endswith("|") and len(body) > 2
    core = body[2 * anchored:len(body) - ended]
    parts = {"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|\Z)"}
    expr = (r"\A(?:[^/?]*\.)?" if anchored else "") + "".join(parts.get(c, re.escape(c)) for c in core) + (r"\Z" if ended else "")
    tokens = []
    for m in _TOKEN.finditer(core):
        before = anchored if m.start() == 0 else core[m.start() - 1] != "*"
        after = ended if m.end() == len(core) else core[m.end()] != "*"
        if before and after:
            tokens.append(m[0])
    return Rule(line, expr, "allow" if line.startswith("@@") else "block", tuple(tokens))


def base_rule(host: str, path: str, verdict: str) -> Rule:
    text = host + path
    closed = path.endswith("/")
    found = [m[0] for m in _TOKEN.finditer(text.translate(_FOLD)) if closed or m.end() < len(text)]
    return Rule(text, r"\A(?:[^/]*\.)?" + re.escape(text), verdict, tuple(found), len(text))


def default_rules() -> list[Rule]:
    return [base_rule(*b) for b in BASE] + [pattern_rule(p) for p in PATTERNS]


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path, and the path with the query, without the fragment."""
    _, _, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0]
    tail = rest[len(host):].partition("#")[0]
    return host.translate(_FOLD), tail.partition("?")[0], tail


def frequencies(pages: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; one row a token and task is shuffled."""
    def count(batches):
        n: dict[str, int] = defaultdict(int)
        for b in batches:
            for u in b.column(url).to_pylist():
                host, _, tail = parts(u)
                for t in tokens.intersection(_TOKEN.findall(host + tail.translate(_FOLD))):
                    n[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])
    got = pages.select(url).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in got.collect()}   # a row for each of the rules' tokens, at most


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], often: dict[str, int]):
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = rules
        for k, r in enumerate(rules):
            (self.filed[min(r.tokens, key=lambda t: (often.get(t, 0), t))] if r.tokens else self.always).append(k)
        self.compiled = [re.compile(r.regex, re.DOTALL) for r in rules]
        self.ran = 0

    def candidates(self, text: str) -> list[int]:
        return sorted({k for t in self.filed.keys() & set(_TOKEN.findall(text)) for k in self.filed[t]}.union(self.always))

    def judge(self, url: str | None) -> tuple:
        """host, path, rule, verdict, pattern."""
        host, path, tail = parts(url)
        base = best = None
        for k in self.candidates(host + tail.translate(_FOLD)) if host or tail else ():
            r = self.rules[k]
            self.ran += 1
            if r.base:
                if self.compiled[k].search(host + path) and (base is None or r.base > base.base):
                    base = r
            elif self.compiled[k].search(host + tail.translate(_FOLD)) and (best is None or (r.verdict, r.text) < (best.verdict, best.text)):
                best = r
        verdict = base.verdict if base else best.verdict if best else "allow"
        return host, path, base and base.text, verdict, best and best.text


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the host-and-path rule that decided), verdict and pattern (the first pattern that fits,
    allowing ones before blocking ones, then by text)."""
    rules = default_rules() if rules is None else rules
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules are more than {RULES}")
    often = frequencies(pages, {t for r in rules for t in r.tokens}, url)
    sent = pages.sparkSession.sparkContext.broadcast((rules, often))
    state: list = []

    def run(urls):
        if not state:
            state.append(Index(*sent.value))
        return list(zip(*map(state[0].judge, urls))) or [[]] * 5
    return map_texts(pages, run, ADDED, column=url, keep=True)


def _sql() -> str:
    quote = lambda x: "'" + x.replace(r"\A", "^").replace(r"\Z", r"\z").replace("'", "''") + "'"
    rows = [r for r in default_rules() if not r.base]
    fits = {v: " OR ".join(f"regexp_matches(target, {quote(r.regex)}, 's')" for r in rows if r.verdict == v) for v in ("allow", "block")}
    base = sorted((r for r in default_rules() if r.base), key=lambda r: -r.base)
    case = lambda f: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{f(h, p, v)}'" for r in base for h, p, v in BASE if h + p == r.text) + " END"
    lower = f"'{_UPPER}', '{_LOWER}'"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, {lower}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, translate(raw || regexp_extract(substr(rest, length(raw) + 1), '^[^#]*'), {lower}) AS target FROM h),
v AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said, target <> '' AND ({fits['allow']}) AS good, target <> '' AND ({fits['block']}) AS bad FROM p)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bad AND NOT good THEN 'block' ELSE 'allow' END) AS verdict FROM v"""


SQL = _sql()
