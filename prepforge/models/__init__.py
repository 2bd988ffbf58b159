"""Estimators fitted on distributed data; the fitted state is small."""
