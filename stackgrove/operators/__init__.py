"""Operators on call events and calling context trees."""
