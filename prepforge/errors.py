"""Exceptions raised by the library."""


class PrepForgeError(Exception):
    """Base class: catch this to catch every error the library raises itself."""


class DataError(PrepForgeError):
    """A dataset is missing, malformed or incompatible with the request."""


class TrainingError(PrepForgeError):
    """A training run was configured wrongly or failed."""


class DuplicateDataError(TrainingError):
    """A fine-tuning run would reuse data its base model has already seen."""


class RegistryError(PrepForgeError):
    """A model version is missing, inconsistent or has been tampered with."""


class InferenceError(PrepForgeError):
    """A scoring request does not fit the model."""
