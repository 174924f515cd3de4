"""Signs that stand for digits, where an operator reads Han text and the tables have none."""

SIGNS = "厚度石材防护板面层施"
