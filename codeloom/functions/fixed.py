"""Patterns, word lists and constants that decide results and must be exactly these.

Patterns are written for engines whose ``.`` and ``$`` know only the line feed and whose ``\\w``, ``\\s`` and ``\\b`` are
Unicode-aware: prefix them with ``JAVA_FLAGS`` for Spark.
"""

# Fixed values.
JAVA_FLAGS = "(?dU)"

BLOCK_COMMENT = r"/\*.*?\*/"
LINE_COMMENT = r"//[^\n]*"
#: Possessive, so that long literals need no stack; matches what the alternation under a star matches.
STRING_LITERAL_JAVA = r'"(?:[^"\\]++|\\.)*+"'
STRING_LITERAL = r'"(?:[^"\\]|\\.)*"'

MAIN_PATTERNS = (
    r"\b(?:int|signed)\s+main\s*\(\s*(?:void)?\s*\)",
    r"\b(?:int|signed)\s+main\s*\([^)]*\bchar\b",
    r"\bvoid\s+main\s*\(\s*(?:void)?\s*\)",
)

#: In order of precedence.
TEST_FRAMEWORKS = (
    ("GoogleTest", r"\bTEST\s*\(\s*\w+\s*,\s*\w+\s*\)|\bTEST_F\s*\(\s*\w+\s*,\s*\w+\s*\)|\bTEST_P\s*\(\s*\w+\s*,\s*\w+\s*\)|\bINSTANTIATE_TEST_SUITE_P\s*\("),
    ("Catch2", r'\bTEST_CASE\s*\(\s*"[^"]*"\s*\)|\bSECTION\s*\(\s*"[^"]*"\s*\)|\bREQUIRE\s*\(|\bCHECK\s*\('),
    ("doctest", r'\bTEST_CASE\s*\(\s*"[^"]*"\s*\)|\bSUBCASE\s*\(\s*"[^"]*"\s*\)|\bDOCTEST_'),
    ("BoostTest", r"\bBOOST_AUTO_TEST_CASE\s*\(|\bBOOST_FIXTURE_TEST_CASE\s*\(|\bBOOST_TEST_MODULE\b|\bBOOST_AUTO_TEST_SUITE\s*\("),
    ("Benchmark", r"\bBENCHMARK\s*\(\s*\w+\s*\)|\bBENCHMARK_F\s*\("),
)

LOCAL_INCLUDE = r'^\s*#\s*include\s*"([^"]+)"'
ALWAYS_PRESENT_HEADER = "bits/stdc++.h"

INCLUDE = r'^\s*#\s*include\s*[<"]'
FUNCTION = r"\b(?:void|int|long|float|double|char|bool|string|auto|unsigned|size_t|ll|pair|vector|map|set|struct|class)\s+[a-zA-Z_]\w*\s*\([^)]*\)\s*\{"
FOR = r"\bfor\s*\("
WHILE = r"\bwhile\s*\("
IF = r"\bif\s*\("
ELSE_IF = r"\belse\s+if\s*\("
SWITCH = r"\bswitch\s*\("
CLASS = r"\bclass\s+[a-zA-Z_]\w*"
NAMESPACE = r"\bnamespace\s+[a-zA-Z_]\w*"
TEMPLATE = r"\btemplate\s*<"
LAMBDA = r"\[\s*(?:&|=)?\s*\]\s*\("
RETURN = r"\breturn\b"
DECISION = r"\b(?:if|else\s+if|for|while|switch|case\s+(?!.*:.*=)|&&|\|\||\?\s*.*\s*:)\b"
#: Without the look-ahead, for engines that have none: the same on texts without case labels.
DECISION_NO_CASE = r"\b(?:if|else\s+if|for|while|switch|&&|\|\||\?\s*.*\s*:)\b"

STL_TOKENS = (
    "vector", "map", "unordered_map", "queue", "priority_queue", "stack", "deque", "set", "unordered_set", "string", "iostream", "fstream", "sstream", "algorithm",
    "sort", "lower_bound", "upper_bound", "pair", "tuple", "cmath", "cstdio", "cstdlib", "cstring", "bits/stdc++.h", "iterator", "numeric", "functional",
)

#: Characters that the str.strip of the original removes.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

TRUE_WORDS_A = ("true", "1", "yes", "pass")
TRUE_WORDS_B = ("true", "1", "yes")

RETRYABLE_TEXTS = ("timeout", "timed out", "connection", "connectionerror", "rate_limit", "429", "500", "502", "503", "server error", "service unavailable", "internal server error", "bad gateway", "gateway timeout")
RETRYABLE_CLASS_PARTS = ("connection", "timeout")

ADAPTIVE_FAILURES_TO_REDUCE = 2
ADAPTIVE_SUCCESSES_TO_RAISE = 8
ADAPTIVE_COOLDOWN_SECONDS = 5.0
ADAPTIVE_MIN = 2

BOUNDARY_VALUES = (0, 1, -1, 255, -255, 65535, -65535, 1000000, -1000000)
EDGE_INPUTS = ("0\n", "-1\n", "999999999\n", "-999999999\n", "0 0\n", "1 2 3 4 5\n")
INT_RANGES = {"short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "longlong": (-(2**63), 2**63 - 1)}
MAX_ARRAY_SIZE = 10
MAX_INPUT_SIZE = 4096
NESTED_ARRAY_SIZE = 3
MAX_COMPACT_FAILURES = 8
MAX_DETAILED_FAILURES = 10
ROLLING_WINDOW = 20

#: What a program reads: declarations, scalar reads, element reads, cell reads, loops with their bound.
READ_DECLARATION = r"\b(int|long\s+long|long|short|float|double|char|string)\s+([a-zA-Z_]\w*(?:\s*\[[^\]]*\])?\s*(?:,|;|=|$))"
READ_SCALARS = r"cin\s*>>\s*([a-zA-Z_]\w*(?:\s*>>\s*[a-zA-Z_]\w*)*)\s*;"
READ_ELEMENT = r"cin\s*>>\s*([a-zA-Z_]\w*)\s*\[\s*[a-zA-Z_]\w*\s*\]"
READ_CELL = r"cin\s*>>\s*([a-zA-Z_]\w*)\s*\[\s*[a-zA-Z_]\w*\s*\]\s*\[\s*[a-zA-Z_]\w*\s*\]"
READ_LOOP = r"for\s*\([^;]*;\s*([a-zA-Z_]\w*)\s*<\s*([a-zA-Z_]\w*)\s*;[^)]*\)"
STRATEGIES = ("random", "boundary", "edge", "heuristic")
EDGE_NUMBERS = ("0", "-1", "999999999", "-999999999")
HEURISTIC_MODES = ("boundary", "zero", "small", "random")
HEURISTIC_BOUNDARIES = (0, 1, -1, 255, -255, 1000000, -1000000)
SMALL_REACH, RANDOM_REACH, REAL_REACH, TEXT_REACH = 100, 10_000, 1000.0, 1000
