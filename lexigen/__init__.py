"""lexigen: Spark DataFrame toolkit for preparing, generating, parsing and scoring
text-generation data (prompt/response pairs, batch inference, list and rubric
parsing, EM/BLEU/ROUGE evaluation, fine-tuning examples)."""

__version__ = "0.1.0"
