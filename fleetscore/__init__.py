"""Scorecards, trends and diagnosis for fleets of conversational data assistants, on Spark."""
