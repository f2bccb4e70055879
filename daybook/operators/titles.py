"""What a window's title tells: kind of app, tool, project, domain, agent; and rules that class a title where no classification is stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of apps, tools and domains that decide the results.
TERMINALS = ["kitty", "foot", "wezterm", "alacritty"]
BROWSERS = ["chrome", "firefox", "zen", "floorp"]
PLAYERS = ["mpv", "vlc", "spotify"]
CHATS = ["weechat", "discord", "slack", "telegram"]
SYSTEM = ["polkit", "blueman", "gcr-prompter", "xdg-desktop-portal", "rawlog-capture", "clipse", "antigravity", "steam"]
EDITORS = ["code", "obsidian", "logseq", "typora", "notes-scratch"]
NOTE_EDITORS = ["obsidian", "logseq", "typora"]
PATH_TOOLS = {"nvim ": "nvim", "vim ": "nvim", "bat ": "bat", "git ": "git"}
PLAIN_TOOLS = {"btop": "btop", "ranger": "file_manager", "Yazi": "file_manager", "pingg": "network", "ping ": "network"}
LATER_TOOLS = {"nix ": "nix", "just ": "just"}
AI_DOMAINS = ["chatgpt.com", "claude.ai", "aistudio.google.com"]
CATEGORIES = {
    "chatgpt.com": "ai", "claude.ai": "ai", "openai.com": "ai",
    "aistudio.google.com": "ai", "anthropic.com": "ai",
    "alignment.anthropic.com": "ai", "elevenlabs.io": "ai",
    "github.com": "code", "docs.rs": "docs", "crates.io": "docs",
    "stackoverflow.com": "docs", "doc.rust-lang.org": "docs",
    "rust-book.cs.brown.edu": "docs", "nixos.wiki": "docs",
    "nix.dev": "docs",
    "wikipedia.org": "reading",
    "youtube.com": "media", "music.youtube.com": "media",
    "spotify.com": "media", "twitch.tv": "media",
}
#: First characters of a title while an agent runs: braille patterns but the blank one, and some signs.
SPINNER = "[⠁-⠿✳✦◇◆●○]"
#: Agents that set a terminal's title: the spinner's own, with the words that name it; others with the word that their titles begin with.
SPINNING_AGENT = ("claude-code", "Claude Code")
STARTED_AGENT = ("codex", "resume")
LIFECYCLE = {
    "start coding session": "claude-code", "claude-code:idle": "claude-code", "claude code": "claude-code",
    "codex resume --last": "codex", "codex": "codex",
}
CAVEAT = "<local-command-caveat>"

FEATURES = "app_kind string, tool string, project string, domain string, domain_category string, is_ai_tool boolean, is_ai_active boolean"


def first_of(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda w, p: w.when(*p), pairs[1:], F.when(*pairs[0])) if pairs else F.lit(None)
    return out if otherwise is None else out.otherwise(otherwise)


def found_by(table: dict[str, str], test: Callable[[Column], Column]) -> Column:
    """The value of the first entry whose key passes, null where none does; the table is one literal, so that what is tested stands once."""
    if not table:
        return F.lit(None).cast("string")
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])
    return F.get(F.filter(entries, lambda e: test(e["k"])), F.lit(0))["v"]


def holds(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``c``, which is computed once however often ``then`` names it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def project_of(raw: Column, projects: list[str]) -> Column:
    """A project by the name of its folder: itself if known, a known one that it begins with, else what is left without a trailing ; or _."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(raw, ";+\\z", ""), "_+\\z", ""))
    known = {p: p for p in projects}
    return F.when(~bare.isin("", ".", "..", "~"), F.coalesce(found_by(known, lambda k: bare == k), found_by(known, lambda k: bare.startswith(k)), bare))


def domain_category(domain: Column, categories: dict[str, str]) -> Column:
    """By the domain itself, else by the first known domain that one of the two ends with."""
    return F.coalesce(found_by(categories, lambda k: domain == k), found_by(categories, lambda k: domain.endswith(k) | k.endswith(domain)))


def title_features(app: Column, title: Column, projects: list[str], folder: str = "/projects/", categories: dict[str, str] = CATEGORIES) -> Column:
    """A struct of FEATURES. ``folder`` is where projects lie in paths; ``projects`` the known names, of which the first that fits wins.

    A null app or title counts as empty. An empty title tells the app's kind only. Pure column expressions: no shuffle, no Python.
    """
    app, title = F.coalesce(app, F.lit("")), F.coalesce(title, F.lit(""))
    t, none = trimmed(title), F.lit(None).cast("string")
    in_folder = lambda c: F.nullif(F.regexp_extract(c, folder + r"([^/\s:;]+)", 1), F.lit(""))

    def made(kind, tool=none, project=none, domain=none, category=none, ai=F.lit(False), active=F.lit(False)) -> Column:
        lit = lambda c: F.lit(c) if isinstance(c, str) else c
        return F.struct(*[c.alias(n.split()[0]) for c, n in zip(map(lit, (kind, tool, project, domain, category, ai, active)), FEATURES.split(", "))]).cast(f"struct<{', '.join(f.replace(' ', ':') for f in FEATURES.split(', '))}>")

    agent, agent_words = SPINNING_AGENT
    other, waiting = STARTED_AGENT
    in_parens = F.regexp_extract(t, r"\(([a-z][\w-]*)\)\s*\z", 1)
    names = {p: p for p in projects}
    known = F.coalesce(found_by(names, lambda k: in_parens == k), found_by(names, lambda k: in_parens.startswith(k)))
    starts = lambda tools: found_by(tools, t.startswith)
    path = in_folder(t)
    tool = F.coalesce(starts(PLAIN_TOOLS), F.when(F.lower(t).contains("weechat"), "weechat"), starts(LATER_TOOLS))
    terminal = first_of(
        [
            (t.rlike(r"\A" + SPINNER), made("terminal", agent, known, ai=F.lit(True), active=F.lit(True))),
            (t.contains(agent_words), made("terminal", agent, ai=F.lit(True))),
            (t.startswith(other), made("terminal", other, ai=F.lit(True), active=~t.contains(waiting))),
            (path.isNotNull(), made("terminal", starts(PATH_TOOLS), project_of(path, projects))),
            (t.rlike(r"\A\w+@[\w-]+:[^\n]+\z"), made("terminal")),
        ],
        made("terminal", tool),
    )
    linked = F.coalesce(F.nullif(F.regexp_extract(title, r" - https?://([^/\s]+)", 1), F.lit("")), F.nullif(F.regexp_extract(title, r"https?://([^/\s]+)", 1), F.lit("")))
    domain = F.regexp_replace(F.lower(linked), r"\Awww\.", "")
    parts = F.split(title, " · ", -1)
    repo = F.when(F.size(parts) >= 2, F.lower(trimmed(F.try_element_at(parts, F.lit(-2)))))
    browser = made("browser", none, F.when((domain == "github.com") & repo.isin(*projects), repo), domain, domain_category(domain, categories), F.coalesce(domain.isin(*AI_DOMAINS), F.lit(False)))
    named = found_by(names, F.lower(title).contains)
    kinds = [(app.isin(*TERMINALS), "terminal"), (holds(app, BROWSERS), "browser"), (app.isin(*PLAYERS), "media_player"), (app.isin(*NOTE_EDITORS), "editor")]
    kind = first_of([(c, F.lit(k)) for c, k in kinds], F.lit("other"))
    return first_of(
        [
            (title == "", made(kind)),
            (app.isin(*TERMINALS), terminal),
            (holds(app, BROWSERS), browser),
            (app.isin(*PLAYERS), made("media_player", app)),
            (holds(app, CHATS), made("chat", F.element_at(F.split(app, "-", -1), -1))),
            (holds(app, SYSTEM), made("system", app, F.when(F.lower(app).contains("antigravity"), named))),
            (app.isin(*EDITORS), made("editor", app, project_of(in_folder(title), projects))),
        ],
        made(kind),
    )


RULE = "rule string, activity string, content_type string, mode string, attention string, topic string, subject string, tool string, is_ai_tool boolean, is_ai_active boolean, confidence double"


def title_rule(app: Column, title: Column, projects: list[str], aliases: dict[str, str], prefixes: dict[str, str], parts: dict[str, str]) -> Column:
    """A struct of RULE by the first rule that fits, null where none does or app or title is empty.

    Rules: a sentinel that begins the title; a title that marks an agent's turns; then, in a terminal: the name of a project (a whole name or
    alias, what it begins with, what it contains, in this order), a slug of three or more words, a short sentence.
    """
    terminal = F.lower(app).isin("kitty", "foot")
    chat = ("chatting_work", "chat_interface", "coding")

    def made(rule, activity, content, mode, subject=None, tool=None, ai=False, confidence=0.7) -> Column:
        values = (rule, activity, content, mode, "deep", "programming", subject, tool, ai or None, ai or None, confidence)
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(f.split()[1]).alias(f.split()[0]) for v, f in zip(values, RULE.split(", "))])

    whole = {p.lower(): p for p in projects} | {a.lower(): c for a, c in aliases.items()}
    begins = prefixes | {f"{p}-": p for p in projects} | {f"{a}-": c for a, c in aliases.items() if "-" not in a and " " not in a and a != c}

    def by(nt: Column, low: Column) -> Column:
        subject = F.coalesce(found_by(whole, lambda k: low == k), found_by(begins, low.startswith), found_by(parts, low.contains))
        turn = found_by(LIFECYCLE, lambda k: low == k)
        rules = [
            (nt.startswith(CAVEAT), made("sentinel", *chat, tool=SPINNING_AGENT[0], ai=True)),
            (turn.isNotNull(), made("lifecycle", *chat, tool=turn, ai=True)),
            (terminal & (low != "") & subject.isNotNull(), made("project", "reading_code", "code", "coding", subject=subject)),
            (terminal & low.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+){2,}\z"), made("slug", "planning", "documentation", "planning", confidence=0.6)),
            (terminal & F.length(nt).between(8, 100) & nt.rlike(r"\A[A-Z][A-Za-z0-9]*(?:[\x20\x09-\x0D]+[A-Za-z0-9/.\-]+){1,15}\z"), made("sentence", *chat, tool=SPINNING_AGENT[0], ai=True, confidence=0.5)),
        ]
        return first_of(rules)

    rule = once(trimmed(title), lambda nt: once(F.lower(nt), lambda low: by(nt, low)))
    return F.when((F.coalesce(app, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != ""), rule)
