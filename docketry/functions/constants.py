"""Fixed values of legal writing that results depend on."""

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    "v.", "vs.", "inc.", "ltd.", "corp.", "co.", "no.", "nos.",
    "app.", "crim.", "civ.", "ct.", "dist.", "supp.", "rev.",
    "stat.", "ann.", "gen.", "ass.", "ch.", "cl.", "div.",
    "ed.", "ex.", "fed.", "gov.", "jr.", "sr.", "mr.", "mrs.",
    "ms.", "dr.", "prof.", "rep.", "sen.", "st.", "tex.", "cal.",
    "n.y.", "fla.", "u.s.", "s.w.", "n.w.", "s.e.", "n.e.",
    "so.", "f.", "l.", "r.", "s.", "w.", "p.", "proc.", "evid.",
    "art.", "n.", "e.g.", "cf.", "i.e.", "et.", "al.",
    "cir.", "pet.", "op.", "cert.", "reh.", "aff.", "mem.",
    "s.w.2d", "s.w.3d", "n.w.2d", "n.e.2d", "s.e.2d", "so.2d",
    "so.3d", "f.2d", "f.3d", "f.4th", "l.ed.", "l.ed.2d", "s.ct.",
)
# Further abbreviations of the wide variant of the test.
MORE_ABBREVIATIONS = ("id.", "ref'd", "dism'd", "tex.app.", "tex.crim.app.")

# Signals before a citation, in their usual order.
SIGNALS = ("see, e.g.,", "see also", "see generally", "but see", "but cf.", "see", "cf.", "compare", "contra", "e.g.,", "accord", "citing")

# Verbs that open an explanatory parenthetical.
VERBS = (
    "holding", "stating", "finding", "noting", "explaining", "observing",
    "concluding", "reasoning", "emphasizing", "recognizing", "determining",
    "clarifying", "reaffirming", "affirming", "reversing", "quoting",
    "citing", "discussing", "describing", "providing", "defining",
)
#: The first fifteen, before "that", in the free-standing form.
THAT_VERBS = VERBS[:15]
# Further verbs of the wide variant.
MORE_VERBS = ("establishing", "requiring", "permitting", "allowing", "prohibiting")

# Reporters and the folders of their cases.
REPORTER_SLUGS = {
    "S.W.": "sw",
    "S.W.2d": "sw2d",
    "S.W.3d": "sw3d",
    "N.W.": "nw",
    "N.W.2d": "nw2d",
    "N.E.": "ne",
    "N.E.2d": "ne2d",
    "N.E.3d": "ne3d",
    "S.E.": "se",
    "S.E.2d": "se2d",
    "So.": "so",
    "So.2d": "so2d",
    "So.3d": "so3d",
    "P.": "p",
    "P.2d": "p2d",
    "P.3d": "p3d",
    "F.": "f",
    "F.2d": "f2d",
    "F.3d": "f3d",
    "F.4th": "f4th",
    "F. Supp.": "f-supp",
    "F. Supp. 2d": "f-supp-2d",
    "F. Supp. 3d": "f-supp-3d",
    "U.S.": "us",
    "S. Ct.": "s-ct",
    "L. Ed.": "l-ed",
    "L. Ed. 2d": "l-ed-2d",
    "Tex.": "tex",
    "Tex. Crim.": "tex-crim",
    "Tex. Crim. App.": "tex-crim",
    "Tex. App.": "tex-ct-app",
    "Tex. Civ. App.": "tex-civ-app",
}

# First words of names that are kept whole.
PLAINTIFF_BODIES = ("united", "people", "state", "commonwealth", "in")
DEFENDANT_BODIES = ("the", "state", "united", "people", "commonwealth")

# Underline colours (red, green, blue) by type.
COLOURS = {"statement": (0.0, 0.6, 0.0), "quotation": (0.0, 0.0, 0.8), "block_quotation": (0.5, 0.0, 0.5), "citation": (0.8, 0.0, 0.0)}

# Patterns that results depend on.
CITATION_CORE = r"\d+\s+[A-Z][A-Za-z.]+(?:\s*\d*[a-z]*d?)?\s+\d+"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"
SPLIT_WORD = r"(\w+)-\s+(\w+)"
SPLIT_LINE_WORD = r"(\w+)-\s*\n\s*(\w+)"
BRACKETED = r"\[[^\]]*\]"
TAG = "<[^>]+>"
ANNOTATION = r"(?i)^\([^)]*(?:added|omitted|altered|supplied|cleaned up|quotation marks?|citations?|internal|emphasis|footnote)[^)]*\)\s*\.?\s*"
SIC = r"(?i)\s*\[sic\]\s*"
VERSUS = r"\s+v\.?\s+"
CASES_PART = r"(?is)Cases\s*\n(.*?)(?:Statutes|Rules|Other|\z)"
