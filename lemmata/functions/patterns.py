"""Tables of patterns, types and weights, as data; users may pass tables of their own."""

# Entity types in emission order, with their LaTeX environment patterns (Java and RE2 syntax).
THEOREM_LIKE = ("definition", "theorem", "lemma", "proposition", "corollary", "assumption", "remark")
ENTITY_PATTERNS = {t: rf"(?s)\\begin\{{{t}\}}(?:\[(.*?)\])?(.*?)\\end\{{{t}\}}" for t in THEOREM_LIKE} | {
    "equation": r"(?s)\\begin\{equation\}(?:\*)?(.*?)\\end\{equation\}(?:\*)?",
    "equation_star": r"(?s)\\begin\{equation\*\}(.*?)\\end\{equation\*\}",
}
LABEL = r"\\label\{(.*?)\}"
REF = r"\\(?:ref|eqref|cref)\{(.*?)\}"
# Category of each type, in report order.
CATEGORIES = {"definition": "definitions", "theorem": "theorems", "lemma": "lemmas", "proposition": "propositions", "corollary": "corollaries", "assumption": "assumptions", "remark": "remarks"}
# Colours of the exports.
COLORS = {"definition": "#4CAF50", "theorem": "#2196F3", "lemma": "#FF9800", "proposition": "#9C27B0", "corollary": "#E91E63", "assumption": "#F44336", "remark": "#607D8B"}
DEFAULT_COLOR = "#999999"
# Review features as (name, lower-case first, ignore case, alternatives, points).
REVIEW = (
    ("specific_theorem_analysis", True, (r"theorem\s+\d+", r"proposition\s+\d+", r"lemma\s+\d+", "the main result", "the proof of"), 10),
    ("error_identification", True, ("error", "incorrect", "wrong", "mistake", "imprecise", "unclear", "undefined"), 10),
    ("proof_gap_analysis", True, ("gap", "missing step", "not clear", "needs proof", "should be justified", "citation needed"), 10),
    ("notation_criticism", True, ("notation", "symbol", "consistent", "confusing", "undefined"), 0),
    ("cites_theorem_numbers", False, (r"Theorem\s+\d+", r"Thm\.?\s*\d+"), 8),
    ("cites_definition_numbers", False, (r"Definition\s+\d+", r"Def\.?\s*\d+"), 0),
    ("quotes_paper", False, (r"""["'][^"']{20,}["']""", r"Equation\s*\(\s*\d+\s*\)", r"\(\\ref\{[^}]+\}\)"), 8),
    ("concrete_suggestions", True, (r"should\s+\w+", r"needs\s+to\s+\w+", r"add\s+", r"clarify\s+", r"prove\s+", r"justify\s+"), 9),
    ("clear_recommendation", True, (r"recommend\s*:?\s*accept", r"recommend\s*:?\s*reject", r"recommend\s*:?\s*revision", r"accept\s*with\s*minor", r"major\s*revision"), 10),
    ("prioritized_issues", True, ("critical", "serious", "major issue", "minor issue", "important"), 5),
    ("severity_assessment", True, ("minor", "major", "critical", "serious"), 5),
    ("actionable", True, (r"should\s+be\s+\w+ed", r"needs\s+to\s+be", r"must\s+provide", r"add\s+a\s+proof", r"clarify\s+that"), 10),
    ("locations", True, (r"in\s+section\s+\d+", r"in\s+theorem\s+\d+", r"after\s+equation", r"before\s+the\s+proof", r"page\s+\d+", r"line\s+\d+"), 5),
)
# Phrases of constructive, negative, objective, subjective and generic reviews.
CONSTRUCTIVE = ("would benefit", "could be improved", "suggest", "recommend")
NEGATIVE = ("this paper is bad", "poor quality", "not worth", "completely wrong")
OBJECTIVE = ("the theorem states", "the proof shows", r"equation\s*\(", r"definition\s+\d+\s+implies")
SUBJECTIVE = ("i think", "i believe", "in my opinion", "obviously", "clearly")
GENERIC = ("the paper needs more explanation", "more details would be helpful", "the writing could be improved", "some parts are unclear")
# Keywords of entities in plain text, by type, in order.
KEYWORDS = {t: (rf"{t.capitalize()}\s+\d+", rf"{t.capitalize()}\.") for t in THEOREM_LIKE}
KEYWORDS["assumption"] += (r"Assume\s+that",)
# Regex candidates as (bucket, pattern, group of the content, element type or group of it, confidence).
SECTION = r"\\(section|subsection|subsubsection)(?:\*?)?\{([^}]+)\}"
CANDIDATE_ENVIRONMENTS = ("theorem", "lemma", "proposition", "corollary", "definition")
# Environments read within sections, in order.
SECTION_PATTERNS = {t: ENTITY_PATTERNS[t] for t in ("theorem", "definition", "lemma", "proposition", "corollary", "remark")} | {
    "equation": r"(?s)\\begin\{equation\}(.*?)\\end\{equation\}",
    "equation_star": r"(?s)\\begin\{equation\*\}(.*?)\\end\{equation\*\}",
}
