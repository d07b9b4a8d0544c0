"""Exceptions raised while a rule is being built or checked against a table."""


class RuleError(Exception):
    """A rule that cannot be evaluated; a rule-set run reports it as ``Error``."""


class RuleConfigError(RuleError):
    """The rule's configuration is incomplete or has a value of the wrong kind."""


class MissingColumnError(RuleError):
    """The rule names a column the table does not have."""

    def __init__(self, column: str):
        super().__init__(f"the table has no column '{column}'")
        self.column = column
