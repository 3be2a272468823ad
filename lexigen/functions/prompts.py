"""Prompt rendering as ``concat`` of constant pieces and columns (constant-folded,
no UDF). The template texts are fixed values: the generated output and the
judge's reading of it depend on them character for character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigen.functions.text import _c

# ---- Fixed values: completion template (Task 2) ----------------------------
COMPLETION_HEAD = "Findings:\n"
COMPLETION_TAIL = "\n\nImpression:\n"

# ---- Fixed values: few-shot list template (Task 1 generation) --------------
FEWSHOT_EXAMPLES = [
    "['Multiple renal cysts.']",
    "['Ascending colon cancer.', 'Multiple liver metastases.', "
    "'Small cysts in the right lobe of the liver.']",
    "['Mild hepatic steatosis.', 'Small stones or calcifications in the right kidney, "
    "slightly perirenal effusion bilaterally.']",
]
FEWSHOT_RULES = (
    "\nYou are a clinical radiology AI assistant.\n"
    "Task: generate disease impressions based on free-text radiology findings.   \n"
    "Rules:\n"
    "- Output only as Python list of strings.\n"
    "- Each string should be a concise disease impression.\n"
    "- Do not include any explanations or additional text.\n"
    "- Use formal medical terminology, consistent with the examples provided.\n"
    "Examples:\n"
)
FEWSHOT_INPUT = "Input Findings:\n"
FEWSHOT_TAIL = "\nOutput:\n"

# ---- Fixed values: judge template (Task 1 scoring) -------------------------
SCORE_COLUMNS = [
    "scientific_terminology",
    "coherence",
    "specific_diagnosis",
    "differential_diagnosis",
    "management_recommendations",
    "correctness",
    "comprehensiveness",
    "harmlessness_bias",
]
JUDGE_HEAD = (
    "\n    You are a clinical radiology AI evaluator.\n\n"
    "Compare the following AI-generated impressions with the reference impressions:\n\n"
    "Generated: "
)
JUDGE_MID = "\nReference: "
JUDGE_TAIL = (
    "\n\nScore the generated impressions on a scale from 0 (worst) to 5 (best) for each metric:\n\n"
    "1. Scientific terminology – Are all terms medically accurate and precise?\n"
    "2. Coherence – Is the impression logically structured and easy to understand?\n"
    "3. Specific diagnosis – Does it identify a clear specific disease or radiologic sign?\n"
    "4. Differential diagnosis – Are relevant alternative diagnoses mentioned (if appropriate)?\n"
    "5. Management recommendations – Are follow-up tests or exams suggested appropriately?\n"
    "6. Correctness – Are the impressions supported by the imaging findings?\n"
    "7. Comprehensiveness – Does the impression cover all relevant findings?\n"
    "8. Harmlessness / Lack of bias – Is the impression safe and free of bias?\n\n"
    "Return your scores **only as a Python dictionary**, using integers 0–5 for each metric.  \n"
    "Do not add explanations or extra text.\n\n"
    "Example output:\n"
    '{"scientific_terminology": 5, "coherence": 4, "specific_diagnosis": 5, '
    '"differential_diagnosis": 4, "management_recommendations": 3, "correctness": 5, '
    '"comprehensiveness": 5, "harmlessness_bias": 5}\n'
)


def fewshot_prefix(examples=None) -> str:
    ex = FEWSHOT_EXAMPLES if examples is None else list(examples)
    return FEWSHOT_RULES + "".join(e + "\n" for e in ex) + FEWSHOT_INPUT


def render_completion_prompt(findings) -> Column:
    """``Findings:\\n{f}\\n\\nImpression:\\n`` (missing findings print as ``nan``)."""
    f = F.coalesce(_c(findings), F.lit("nan"))
    return F.concat(F.lit(COMPLETION_HEAD), f, F.lit(COMPLETION_TAIL))


def render_fewshot_prompt(findings, examples=None) -> Column:
    f = F.coalesce(_c(findings), F.lit("nan"))
    return F.concat(F.lit(fewshot_prefix(examples)), f, F.lit(FEWSHOT_TAIL))


def render_judge_prompt(generated, reference) -> Column:
    g = F.coalesce(_c(generated), F.lit("nan"))
    r = F.coalesce(_c(reference), F.lit("nan"))
    return F.concat(F.lit(JUDGE_HEAD), g, F.lit(JUDGE_MID), r, F.lit(JUDGE_TAIL))


def full_text(prompt, response, eos: str) -> Column:
    """prompt + response + eos, the training text (missing response prints as ``nan``)."""
    return F.concat(_c(prompt), F.coalesce(_c(response), F.lit("nan")), F.lit(eos))
