"""quirelake.streaming"""
