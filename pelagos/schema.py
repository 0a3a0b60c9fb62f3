"""Canonical schemas and the small dimension tables that operators look values up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A finding as tools emit it: two vocabularies of field names, loose types. Values that do not parse become null.
RAW_FINDING = (
    "struct<type:string,`check`:string,name:string,title:string,severity:string,impact:string,message:string,description:string,"
    "location:struct<file:string,line:string,function:string,snippet:string>,filename:string,file:string,lineno:string,line:string,"
    "function:string,swc_id:string,swc:string,cwe_id:string,cwe:string,confidence:string>"
)
#: One tool's results for one contract.
TOOL_RESULT = (
    "struct<tool:string,contract:string,status:string,execution_time:double,timestamp:string,metadata:map<string,string>,error:string,"
    f"findings:array<{RAW_FINDING}>>"
)
#: A normalized finding.
FINDING = "id string, tool string, severity string, type string, message string, file string, line int, function string, swc_id string, cwe_id string, confidence double"

# Results depend on them, so they are those of the system whose results are matched.
#: Reliability of tools in cross-tool confirmation; others count 0.5.
TOOL_WEIGHT = {
    "slither": 0.85, "aderyn": 0.75, "mythril": 0.90, "halmos": 0.90, "echidna": 0.85, "solhint": 0.40, "smartllm": 0.70,
    "gptscan": 0.65, "iaudit": 0.60, "gptlens": 0.60, "llamaaudit": 0.55, "llmbugscanner": 0.55,
    "classic-pattern-detector": 0.50, "defi-pattern-detector": 0.60,
}
#: Points off a perfect 100; unknown severities cost 5.
SEVERITY_PENALTY = {"critical": 40.0, "high": 15.0, "medium": 5.0, "low": 1.5, "info": 0.3, "informational": 0.3, "optimization": 0.1, "note": 0.3}
#: Rank by which groups choose their most severe row; unknown severities rank 5.
SEVERITY_RANK = {"critical": 10, "high": 8, "medium": 5, "low": 2, "informational": 1, "info": 1, "note": 1, "warning": 3, "optimization": 1}
#: Order in which enhanced findings are listed.
SEVERITY_ORDER = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
#: Weight in the overall risk; unknown severities weigh 5.
RISK_WEIGHT = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 1, "informational": 1}
#: Severity that a tool's own severity stands for.
CALIBRATION = {
    ("aderyn", "Low"): "Medium", ("aderyn", "Info"): "Low", ("solhint", "error"): "Medium", ("solhint", "warning"): "Low",
    ("slither", "Informational"): "Info", ("slither", "Optimization"): "Info",
}
SEVERITY_LABEL = {
    "critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Info", "informational": "Info",
    "optimization": "Info", "warning": "Low", "error": "Medium",
}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
CONFIDENCE_WORD = {"high": 0.9, "medium": 0.7, "low": 0.5}
#: What fingerprints leave out of a message: fingerprints in stored baselines were made with just these.
LINE_REFERENCE = (
    r"(?i)"
    r"\b(?:line|ln|row|col|column|position|offset)s?\s*[:#=]?\s*\d+(?:\s*[:,-]\s*\d+)?"
    r"|(?<![\w.])[:@]\d+(?::\d+)?\b"
    r"|\#\d+\b"
    r"|\bL\d+\b"
)
#: CVSS metric weights.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
PRIVILEGES = {"N": 0.85, "L": 0.62, "H": 0.27}
INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}

# Our own small rule tables: they exercise the operators that take rules as data.
#: Canonical category of exact raw types.
CATEGORY_EXACT = {
    "reentrancy-eth": "reentrancy", "reentrancy-no-eth": "reentrancy", "tx-origin": "access-control", "unchecked-transfer": "unchecked-call",
    "timestamp": "time-manipulation", "arithmetic": "integer-overflow",
}
#: Ordered fragments that decide types without an exact category.
CATEGORY_FRAGMENT = (("reentr", "reentrancy"), ("origin", "access-control"), ("overflow", "integer-overflow"), ("unchecked", "unchecked-call"), ("time", "time-manipulation"))
#: Tool to analysis layer.
TOOL_LAYER = {"slither": 1, "aderyn": 1, "mythril": 3, "smartllm": 5, "gptscan": 5}
#: CVSS vector per category: vector, complexity, privileges, interaction, confidentiality, integrity, availability.
CATEGORY_VECTOR = {
    "reentrancy": ("N", "L", "N", "N", "N", "H", "H"), "access-control": ("N", "L", "N", "N", "L", "H", "L"),
    "integer-overflow": ("N", "H", "N", "N", "N", "H", "L"), "unchecked-call": ("N", "H", "L", "N", "N", "L", "L"),
    "time-manipulation": ("N", "H", "N", "N", "N", "L", "N"),
}
CONTROLS = {
    "reentrancy": ("C1", "C4"), "access-control": ("C2",), "integer-overflow": ("C3", "C4"), "unchecked-call": ("C4",), "oracle": ("C5",),
}
#: Chains of categories that together make an exploit.
CHAINS = {"drain": ("reentrancy", "unchecked-call"), "takeover": ("access-control", "time-manipulation"), "mint": ("integer-overflow", "access-control", "oracle")}


def dimension(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    """A small table of fixed size; keys and values may be tuples."""
    flat = lambda x: x if isinstance(x, tuple) else (x,)
    return spark.createDataFrame([(*flat(k), *flat(v)) for k, v in values.items()], schema)
