"""Log diagnostics on Spark: rule findings, novel-template findings, ranked reports."""

from faultline.plans.find import find, scan
from faultline.plans.train import train
from faultline.rules import RULE_LIBRARY, Rule

__all__ = ["RULE_LIBRARY", "Rule", "find", "scan", "train"]
