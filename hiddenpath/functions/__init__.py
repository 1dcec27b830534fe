"""Part of the hidden Markov library: functions."""
